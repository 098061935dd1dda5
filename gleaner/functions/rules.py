"""Decision tables as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a request must not contain or touch.
DESTRUCTIVE = ["rm -rf", "drop table", "delete from", "format c:", "shutdown -h"]
DENIED_COMMANDS = ["rm -rf /", "mkfs", "dd if=", "shutdown", "reboot", "format c:", "> /dev/sda"]
DENIED_PATHS = ["/etc", "/boot", "/proc/sys", "/sys"]


def _first(column: Column, values: Sequence[str], test) -> Column:
    """The first value that the test finds in the column, or null."""
    return F.coalesce(*[F.when(test(column, v), F.lit(v)) for v in values])


def veto(query: Column) -> Column:
    """REJECT if the query names something destructive, else APPROVE."""
    return F.when(_first(F.lower(query), DESTRUCTIVE, lambda c, v: c.contains(v)).isNotNull(), "REJECT").otherwise("APPROVE")


def sandbox(command: Column, path: Column, host: Column, allowed_hosts: Sequence[str] = ()) -> Column:
    """Why a call is blocked; null if it isn't."""
    bad_command = _first(F.lower(F.coalesce(command, F.lit(""))), DENIED_COMMANDS, lambda c, v: c.contains(v))
    bad_path = _first(F.coalesce(path, F.lit("")), DENIED_PATHS, lambda c, v: c.startswith(v))
    name = F.coalesce(F.parse_url(host, F.lit("HOST")), host)
    reasons = [F.concat(F.lit("command: "), bad_command), F.concat(F.lit("path: "), bad_path)]
    if allowed_hosts:
        reasons.append(F.when((F.coalesce(host, F.lit("")) != "") & ~name.isin(*allowed_hosts), F.concat(F.lit("host: "), name)))
    return F.coalesce(*reasons)


#: The four parts of a mood vector, in order.
PARTS = ["Love", "Logic", "Fear", "Creation"]


def reasoning_mode(wave: Column, complexity: Column, epoch: Column, thresholds: tuple[float, float, float] = (0.3, 0.6, 0.8)) -> Column:
    """The mode for a mood vector and a complexity; every tenth epoch consolidates."""
    low, mid, high = thresholds
    strongest = F.array_max(wave)
    part = F.element_at(F.array(*map(F.lit, PARTS)), F.array_position(wave, strongest).cast("int"))
    middle = F.when(part == "Logic", "theoretical").when(part == "Fear", "active").when(part == "Love", "embodied").otherwise("adaptive")
    return (
        F.when((epoch > 0) & (epoch % 10 == 0), "sleep")
        .when((strongest < 0.35) | (complexity < low), "adaptive")
        .when(complexity < mid, middle)
        .when(complexity < high, F.when(part == "Creation", "hyper").otherwise("alaya"))
        .otherwise("pineal")
    )


def provider(wave: Column, mode: Column, wish: Column, first: str = "claude", second: str = "gemini") -> Column:
    """Which of two model providers answers: the wish, unless it is auto; the second for inventive moods."""
    inventive = mode.isin("hyper", "pineal") & (F.element_at(wave, 4) > F.element_at(wave, 2))
    return F.when(F.coalesce(wish, F.lit("auto")).isin("auto", ""), F.when(inventive, second).otherwise(first)).otherwise(wish)


#: The two constraints by level of surprise: name, wanted state, words to suppress, words to boost,
#: temperature.
CONSTRAINTS = {
    "high": ("Abhaya (Fearlessness)", "Calm", ["fatal", "error", "impossible", "deny"], ["fix", "simple", "safe", "step-by-step"], 0.5),
    "low": ("Desana (Teaching)", "Insight", ["maybe", "I feel", "just"], ["therefore", "optimal", "structure", "logic"], 1.2),
}


def vow(surprise: Column, constraints: dict[str, tuple] = CONSTRAINTS) -> Column:
    """The sampling constraint (name, state, suppress, boost, temperature) for a level of surprise: high above 0.7."""
    fields = ("name", "state", "suppress", "boost", "temperature")
    made = {level: F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in zip(fields, values, strict=True)]) for level, values in constraints.items()}
    return F.when(surprise > 0.7, made["high"]).otherwise(made["low"])


def non_negative(value: float, name: str) -> float:
    """The value, if it is not under 0."""
    if value < 0:
        raise ValueError(f"{name} must not be negative, but is {value}")
    return value


def n_tokens(query: Column) -> Column:
    return F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))


def ambiguity(query: Column) -> Column:
    """CLARIFY if the query asks more than one question."""
    return F.when(F.length(query) - F.length(F.replace(query, F.lit("?"), F.lit(""))) > 1, "CLARIFY").otherwise("APPROVE")


def depth(query: Column) -> Column:
    """How deep a query is: its tokens over 50, at most 1."""
    return F.least(F.lit(1.0), n_tokens(query) / 50.0)


def essence(query: Column) -> Column:
    """The first five words of more than three characters."""
    kept = F.slice(F.filter(F.split(query, r"\s+"), lambda w: F.length(w) > 3), 1, 5)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise("(empty)")


def council(query: Column) -> Column:
    """(verdict, adviser, essence): the advisers are heard in order, and the first that rejects ends it.

    An adviser that asks to clarify doesn't end it; what all of them let pass is approved.
    """
    rejected = veto(query) == "REJECT"
    return F.struct(
        F.when(rejected, "REJECT").otherwise("APPROVE").alias("verdict"),
        F.when(rejected, "safety").when(ambiguity(query) == "CLARIFY", "ambiguity").alias("adviser"),
        essence(query).alias("essence"),
    )


def reasoner(complexity: Column, available: Sequence[str] = ("adaptive", "theoretical", "hyper")) -> Column:
    """The solver for a complexity; one that isn't available gives way to the first that is."""
    wanted = F.when(complexity < 0.3, "adaptive").when(complexity < 0.6, "theoretical").otherwise("hyper")
    return F.when(wanted.isin(*available), wanted).otherwise(available[0])


def cache_key(*values: Column) -> Column:
    """Twelve hex digits that stand for the rounded values."""
    return F.substring(F.md5(F.concat_ws("|", *[F.format_number(v, 3) for v in values])), 1, 12)


def reasoning_vector(wave: Column, moon_phase: Column, illumination: Column, entropy: Column, complexity: Column) -> Column:
    """The eight biases of a request: its mood's four parts, the moon's phase and light (per cent), an entropy and
    the complexity."""
    return F.concat(wave, F.array(moon_phase, illumination / 100.0, entropy, complexity))
