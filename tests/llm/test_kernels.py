"""The array kernels of the operators against plain Python."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from gleaner.llm import decontamination, near_duplicates, ngram_lm, token_output
from gleaner.llm.common import mix64, slices, words_of

ODD = ["", None, " ", "\n\t", "a", "A b", "  x  y\x0bz ", "É é ß", "it's 's 5km", "<|endoftext|> x", "\x00\x1cq", "don't!!'s (a)-b_c", "ÀB ÇA ñandú ÿ ÷ x÷y", "ĺ éx", "日本語 テキスト", "a" * 5000]


def random_texts(n, seed=1, words=30, length=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdé,.'5", k=rng.randint(1, 4))) for _ in range(words)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, length))) for _ in range(n)] + ODD


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_words():
    texts = random_texts(50)
    for array in (pa.array(texts), pa.array(["x", *texts])[1:]):
        flat, starts = words_of(array)
        flat = flat.to_pylist()
        assert [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)] == [plain(t) for t in texts]


def test_slices_keep_all_rows():
    batch = pa.record_batch([pa.array(random_texts(100))], ["text"])
    for rows, size in ((7, 1 << 20), (1000, 300), (1, 1)):
        parts = list(slices(batch, "text", rows, size))
        assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
        assert max(p.num_rows for p in parts) <= rows
    assert list(slices(batch.slice(0, 0), "text")) == []


def test_mixing_is_a_bijection():
    keys = np.random.default_rng(0).integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert (ngram_lm.unmix64(mix64(keys)) == keys).all()
    keys.sort()
    assert (ngram_lm._unpack(ngram_lm._pack(keys)) == keys).all()


def brute_hits(texts, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = []
    for name, text in items:
        words = re.findall(pattern, low(text))
        size = min(window, len(words))
        windows += [(name, tuple(words[i : i + size])) for i in range(len(words) - size + 1) if size]
    out = []
    for text in texts:
        words = re.findall(pattern, low(text))
        hit, names = set(), set()
        for name, w in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    names.add(name)
        out.append((len(words), sorted(hit), sorted(names)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_windows_found(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "cé", "d0", "Zz"][: rng.randint(2, 5)]
    words = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(str(i), words(rng.choice([0, 1, 2, 5, 9, 10, 11, 14]))) for i in range(12)] + [("x", words(3)), ("x", "")]
    texts = [words(rng.randint(0, 60)) for _ in range(30)] + ODD + [None, items[5][1], "a. " * 30]
    block = decontamination.Benchmark(items, 10)
    lengths, starts, places, windows = block.search(pa.array(texts))
    got = [[int(n), set(), set()] for n in lengths]
    for p, w in zip(places, windows, strict=True):
        d = int(np.searchsorted(starts, p, "right")) - 1
        got[d][1] |= set(range(p - starts[d], p - starts[d] + block.size[w]))
        got[d][2] |= {block.names[i] for i in block.owner[block.runs[w] : block.runs[w + 1]]}
    assert [(n, sorted(h), sorted(i)) for n, h, i in got] == brute_hits(texts, items)
    begin, end = decontamination._covered(places, block.size[windows])
    assert sum(end - begin) == sum(len(h) for _, h, _ in got)


def longest_matches(items, texts):
    block = decontamination.Benchmark(items, 10)
    _, starts, places, windows = block.search(pa.array(texts, pa.string()))
    return [tuple(int(x) for x in m) for m in zip(*block.matches(starts, places, windows), strict=True)]


def brute_matches(items, texts):
    """All pairs of places, extended as far as they go."""
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, text in enumerate(map(low, texts)):
        for k, (_, item) in enumerate(items):
            words = low(item)
            for i in range(len(text)):
                for j in range(len(words)):
                    if i and j and text[i - 1] == words[j - 1]:
                        continue
                    n = 0
                    while i + n < len(text) and j + n < len(words) and text[i + n] == words[j + n]:
                        n += 1
                    if n and n >= min(10, len(words)):
                        out.append((d, k, i, j, n))
    return sorted(out)


def test_longest_match():
    item = " ".join(f"w{i}" for i in range(40))
    text = "x y " + " ".join(f"w{i}" for i in range(5, 30)) + " z " + " ".join(f"w{i}" for i in range(12))
    assert longest_matches([("i", item)], [None, text]) == [(1, 0, 2, 5, 25), (1, 0, 28, 0, 12)]


@pytest.mark.parametrize("seed", range(4))
def test_longest_matches(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choices(["a", "b", "cé"], k=n))
    items = [(str(i), words(rng.choice([0, 1, 3, 9, 10, 12, 30]))) for i in range(6)]
    texts = [words(rng.randint(0, 50)) for _ in range(8)] + ["q " + items[-1][1] + " a b " + items[0][1], None, ""]
    assert sorted(longest_matches(items, texts)) == brute_matches(items, texts)


def test_empty_benchmark():
    block = decontamination.Benchmark([], 10)
    assert len(block.search(pa.array(["a b", None]))[2]) == 0


def brute_shingles(text):
    words = plain(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingle_sets():
    texts = random_texts(60, words=3, length=12)
    sets, starts = near_duplicates.shingle_sets(pa.array(texts))
    got = [sets[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    want = [brute_shingles(t) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(got[i]) & set(got[j])) == len(want[i] & want[j])


def test_minwise_agreement():
    rng = np.random.default_rng(3)
    sets = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    a, b = sets[:1000], sets[100:1100]  # similarity 9 / 11
    tokens = near_duplicates.minwise(np.concatenate((a, b)), np.array([0, 1000, 2000]))
    assert abs((tokens[:, 0] == tokens[:, 1]).mean() - 9 / 11) < 0.12


def test_encoder_equals_tokenizer():
    coder = token_output.Encoder(token_output.default_tokenizer())
    texts = random_texts(100, seed=5) + ["A<|ENDOFTEXT|>b", "<|startoftext|>", "x<|endoftext|>", "'S 'LL can'T ''s", "¡Hola! ¿qué? «oui» 12³ ǅ İ", "#$%&*() ~~'re", "naïve café ŒUVRE œuvre"]
    for _ in range(2):
        ids, counts = coder.encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for text, part in zip(texts, parts, strict=True):
            want = coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
            assert part.tolist() == want, text


def test_encoder_of_files_with_other_rules():
    import public_tokenizers

    coder = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = random_texts(40, seed=6) + [" two  spaces ", "line\n\nline", "<|endoftext|>"]
    ids, counts = coder.encode(pa.array(texts))
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert part.tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    assert not coder.by_pieces and token_output.Encoder(token_output.default_tokenizer()).by_pieces


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(token_output, "KEPT", 5)
    coder = token_output.Encoder(token_output.default_tokenizer())
    for seed in range(4):
        texts = random_texts(20, seed=seed)
        ids, counts = coder.encode(pa.array(texts))
        for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert part.tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_discounts():
    assert ngram_lm.discounts(0, 1, 1, 1) == (0.0, 0.5, 1.0, 1.5)
    d = ngram_lm.discounts(100, 50, 30, 20)
    assert d[0] == 0 and 0 <= d[1] <= 1 and d[2] <= 2 and d[3] <= 3


def test_crc_of_ids():
    ids = np.array([1, 49407, 0], np.uint32)
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def test_ranges_of_the_language_model_meet_in_no_task_and_are_sorted_in_little_room(spark, tmp_path):
    ids = spark.range(0, 4000, 1, 1).select(F.col("id").cast("int").alias("x"), F.expr("pmod(hash(cast(id as int)), 61)").alias("at")).collect()
    slots = ngram_lm._slots(61)
    where = {r["x"]: r["at"] for r in ids}
    assert (slots % 61 == np.arange(61)).all() and all(where[int(s)] == k for k, s in enumerate(slots) if int(s) in where)
    assert sum(int(s) in where for s in slots) > 30
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 400) % 5000) for _ in range(1000)]
    batch, folder, ranges = pa.record_batch({"text": pa.array(texts)}), f"file://{tmp_path}", 2
    by_range = lambda batches: [(k, (t := pa.Table.from_batches(batches)).filter(pc.equal(t["range"], int(s)))) for k, s in enumerate(ngram_lm._slots(ranges))]
    write = ngram_lm._write_words(folder, ranges)
    found = [write((pa.scalar(k),), t) for k, t in by_range(list(ngram_lm._count_words(ngram_lm._slots(ranges))(iter([batch]))))]
    sizes = [t["n"][0].as_py() for t in found]
    words = ngram_lm.Words(folder, ranges, [0, sizes[0], sum(sizes)], 401_000, 1000)
    for k, group in by_range(list(ngram_lm._count_triples(words)(iter([batch])))):
        tracemalloc.start()
        ngram_lm._write_triples(words)((pa.scalar(k),), group)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 2.5 * group.nbytes, (most, group.nbytes)
    plain = Counter(t for x in texts for w in [["<", "<", *x.split(), ">"]] for t in zip(w, w[1:], w[2:], strict=False))
    after = [ngram_lm.shared_array(folder, f"after-{k}") for k in range(ranges)]
    counts = np.concatenate([ngram_lm._read_small(folder, f"times-{k}", np.flatnonzero(a <= words.size)) for k, a in enumerate(after)])
    assert sorted(counts.tolist()) == sorted(plain.values())
