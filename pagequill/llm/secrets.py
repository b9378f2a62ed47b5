"""Secret scan: fixed patterns, and a battery of randomness tests on long tokens.

DataFrame functions only. Base spans come from three patterns. Further spans are
tokens that look random: for each token an encoding is inferred from its
characters, and chi-squared uniformity over that alphabet, a runs test and a
lag-1 serial correlation must not contradict randomness. The hypothesis of
ordinary writing is then tested by the evenness of the letters (chi-squared),
by changes between letters and digits, and by capitals without two small letters
behind them, which are few in writing, names included. All make one p-value, where
each counts by what a random token of the encoding and length is expected to
show in it, and the hypothesis is rejected under false-discovery control whose
weights grow with the token's length.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequill.llm.common import materialize

# Fixed patterns. A hex or access run is maximal, so a least length in the
# pattern equals matching any run and dropping short ones.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
# Fixed alphabets by encoding, first that fits.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
    "mixed": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
#: Chance that two letters of ordinary writing are equal.
WRITING_REPEAT = 0.065
#: Chances that ordinary writing changes from a letter to a digit or back, and that a capital is followed by anything but
#: two small letters, where there are small letters. Changes of case say nothing: names are full of them.
WRITING_DIGIT, WRITING_CAPITALS = 0.05, 0.15
MAX_Z = 3.0
FALSE_DISCOVERIES = 0.01
_STEP, _STEPS = 0.05, 1200
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _hits(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<gap, m, v>>: characters before each match (since the last), the match, its group."""
    lit = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, lit, F.lit(0))
    value = F.regexp_extract_all(text, lit, F.lit(group)) if group else found
    rows = F.zip_with(gaps, F.arrays_zip(found.alias("m"), value.alias("v")), lambda g, x: F.struct(g.alias("gap"), x["m"].alias("m"), x["v"].alias("v")))
    kept = F.filter(rows, lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<gap:int,m:string,v:string>>"))


def _positions(rows: DataFrame, hits: str) -> DataFrame:
    """row, start, stop, m, v of the exploded hits; offsets are in code points."""
    out = rows.select("row", F.posexplode(hits).alias("i", "h")).select("row", "i", "h.gap", "h.m", "h.v", F.length("h.m").alias("len"))
    upto = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum((F.col("gap") + F.col("len")).cast("long")).over(upto)
    return out.select("row", stop.alias("stop"), "len", "m", "v").select("row", (F.col("stop") - F.col("len")).alias("start"), "stop", "m", "v")


def _battery(tokens: DataFrame) -> DataFrame:
    """tokens (with v) and: encoding, n, z_chi2, z_runs, z_serial, p (of ordinary writing; 1 if the battery fails)."""
    v = F.regexp_replace("v", "=+$", "")
    fits = [(k, f"^[{a.replace('-', '')}{'-' if '-' in a else ''}]+$") for k, a in ALPHABETS.items()]
    kind = F.lit("mixed")
    for name, pattern in reversed(fits[:-1]):
        kind = F.when(F.col("t").rlike(pattern), name).otherwise(kind)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), F.col("encoding"))
    t = tokens.withColumn("t", v).withColumn("encoding", kind).withColumn("abc", alphabet)
    chars = F.filter(F.split("t", ""), lambda c: c != "")
    t = t.withColumn("cs", chars)
    t = t.withColumn("at", F.expr("transform(cs, c -> cast(locate(c, abc) - 1 as double))"))
    n, k = F.col("n"), F.col("k")
    t = t.withColumns({"n": F.size("cs").cast("double"), "k": F.length("abc").cast("double")})
    squares = F.expr("aggregate(array_distinct(cs), 0D, (s, c) -> s + pow(length(t) - length(replace(t, c, '')), 2))")
    t = t.withColumns({
        "chi2": k / n * squares - n,
        "hi": F.expr("cast(size(filter(at, x -> x >= k / 2)) as double)"),
        "runs": F.expr("1D + size(filter(sequence(1, greatest(size(at) - 1, 1)), i -> i < size(at) and (at[i] >= k / 2) <> (at[i - 1] >= k / 2)))"),
        "mean": F.expr("aggregate(at, 0D, (s, x) -> s + x) / n"),
    })
    t = t.withColumns({
        "ss": F.expr("aggregate(at, 0D, (s, x) -> s + (x - mean) * (x - mean))"),
        "sc": F.expr("aggregate(sequence(1, greatest(size(at) - 1, 1)), 0D, (s, i) -> s + if(i < size(at), (at[i] - mean) * (at[i - 1] - mean), 0D))"),
    })
    both = 2 * F.col("hi") * (n - F.col("hi"))
    runs_var = both * (both - n) / (n * n * (n - 1))
    writing = F.greatest(F.lit(WRITING_REPEAT), 1.6 / k)
    excess = (n - 1) * (k * writing - 1)
    t = t.withColumns({
        "z_chi2": (F.col("chi2") - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n),
        "z_runs": F.when(runs_var > 0, (F.col("runs") - 1 - both / n) / F.sqrt(runs_var)).otherwise(F.lit(99.0)),
        "z_serial": F.when(F.col("ss") > 0, F.col("sc") / F.col("ss") * F.sqrt(n)).otherwise(F.lit(99.0)),
        "z_writing": (k - 1 + excess - F.col("chi2")) / F.sqrt(2 * (k - 1) + 4 * excess),
    })
    # Neighbours that are both letters or digits, how often they change, which capitals don't begin a word, and what a random token would show.
    kinds = F.translate("t", _LOWER + _LOWER.upper() + "0123456789+/=_-", "l" * 26 + "u" * 26 + "d" * 10 + "-" * 5)
    count = lambda pattern: F.regexp_count(kinds, F.lit(f"(?={pattern})")).cast("double")
    t = t.withColumns({"near": count("[lud][lud]"), "changes": count("[lu]d|d[lu]"), "capitals": count("u[lud][lud]"), "odd": count("u(?!ll)[lud][lud]")})
    share = lambda letters: F.length(F.regexp_replace("abc", f"[^{letters}]", "")) / k
    over = lambda found, null, of: F.when(of > 0, (found - of * null) / F.sqrt(of * null * (1 - null))).otherwise(F.lit(0.0))
    expected = F.col("near") * share("A-Z")
    both_cases = F.col("t").rlike("[a-z]") & (share("a-z") > 0) & (share("A-Z") > 0)
    t = t.withColumns({
        "z_kinds": over(F.col("changes"), WRITING_DIGIT, F.col("near")), "e_kinds": over(F.col("near") * 2 * share("0-9") * share("A-Za-z"), WRITING_DIGIT, F.col("near")), "e_writing": excess / F.sqrt(2 * (k - 1) + 4 * excess),
        "z_capitals": over(F.col("odd"), WRITING_CAPITALS, F.col("capitals")), "e_capitals": F.when(both_cases, over(expected * (1 - share("a-z") * share("a-z")), WRITING_CAPITALS, expected)).otherwise(F.lit(0.0)),
    })
    parts = [(F.col(f"e_{c}"), F.col(f"z_{c}")) for c in ("writing", "kinds", "capitals")]
    t = t.withColumn("z", reduce(add, [e * z for e, z in parts]) / F.sqrt(reduce(add, [e * e for e, _ in parts])))
    random = (F.col("z_chi2") <= MAX_Z) & (F.abs("z_runs") <= MAX_Z) & (F.abs("z_serial") <= MAX_Z) & (F.col("z") > 0)
    p = F.when((n >= 16) & random, F.exp(-F.col("z") * F.col("z") / 2)).otherwise(F.lit(1.0))
    return t.withColumn("p", p).select(*tokens.columns, "encoding", "n", "z_chi2", "z_runs", "z_serial", "z_writing", "z_kinds", "z_capitals", "z", "p")


def discovery_limit(tested: DataFrame, rate: float = FALSE_DISCOVERIES) -> tuple[float, float]:
    """(limit, mean length): Benjamini-Hochberg over all tested tokens with weights n / mean length.

    The weighted p-values are counted in at most 1201 steps of -ln p, so what
    comes to the driver is bounded; a token is found if p * mean / n <= limit.
    """
    mean = tested.agg(F.avg("n")).first()[0]
    if not mean:
        return 0.0, 1.0
    step = F.least(F.floor(-F.log(F.col("p") * mean / F.col("n")) / _STEP), F.lit(_STEPS))
    got = sorted(((r["s"], r["k"]) for r in tested.groupBy(step.cast("int").alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, found, limit = sum(k for _, k in got), 0, 0.0
    for s, k in got:
        found += k
        edge = math.exp(-s * _STEP)  # every p of this step or a later one is at most this
        if s > 0 and edge * total <= rate * found:
            limit = edge
    return limit, mean


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per input row: <id_col>, spans: array<struct<start, kind, stop>>, by start, then kind.

    kind is assign, access, hex (the patterns; leftmost, non-overlapping within
    a kind) or random (added by the tests; never over a base span). Offsets count
    code points, stop is exclusive. Null and empty texts have no span; repeated
    rows get equal spans; null ids stay null; an empty table gives none; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    hits = {"assign": _hits(F.col("text"), ASSIGN, 2), "access": _hits(F.col("text"), ACCESS), "hex": _hits(F.col("text"), HEX), "random": _hits(F.col("text"), TOKEN)}
    rows = materialize(rows.select("id", "row", *[c.alias(k) for k, c in hits.items()]), "secret-hits")
    base = None
    for rank, kind in enumerate(KINDS[:3]):
        part = _positions(rows, kind)
        if kind == "assign":
            part = part.where(F.length("v") >= ASSIGN_LEAST)
        part = part.select("row", "start", "stop", F.lit(rank).alias("rank"))
        base = part if base is None else base.unionByName(part)
    tested = materialize(_battery(_positions(rows, "random")).select("row", "start", "stop", "n", "p"), "secret-tests")
    limit, mean = discovery_limit(tested, rate)
    found = tested.where(F.col("p") * mean / F.col("n") <= limit).select("row", "start", "stop", F.lit(3).alias("rank"))
    spans = base.unionByName(found)
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(0, Window.unboundedFollowing)
    is_base = F.col("rank") < 3
    spans = spans.withColumns({"ended": F.max(F.when(is_base, F.col("stop"))).over(before), "next": F.min(F.when(is_base, F.col("start"))).over(after)})
    over = (F.col("ended") > F.col("start")) | (F.col("next") < F.col("stop"))
    spans = spans.where(is_base | ~F.coalesce(over, F.lit(False)))
    lists = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "stop"))).alias("s"))
    out = rows.select("id", "row").join(lists, "row", "left")
    named = F.transform("s", lambda x: F.struct(x["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1).alias("kind"), x["stop"].alias("stop")))
    return out.select(F.col("id").alias(id_col), F.coalesce(named, F.array().cast("array<struct<start:bigint,kind:string,stop:bigint>>")).alias("spans"))
