"""Secret spans by patterns and a randomness test battery; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: The patterns, in the order that breaks ties of one start.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PLAIN_RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{8,19}(?![A-Za-z0-9+/_-])"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "letters": BASE64[:52], "base64": BASE64}
START = 64  # the state before a run's first character
BACK_OFF = 8.0  # uses for which a character's overall rate counts after any other
MOST_BITS = 4000
CHUNK = 512


def _spans(text: Column, pattern: str) -> Column:
    """Matches, leftmost and non-overlapping, as structs of match, start and end in code points.

    Offsets run within chunks, and over the chunks' sums, so many matches in one text cost little more than their number.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, CHUNK))
    none = F.array().cast("array<struct<match:string,start:int,end:int>>")

    def step(a, x):
        start = a["at"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(x["m"].alias("match"), start.alias("start"), end.alias("end")))).alias("out"))

    local = F.transform(chunks, lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    shifted = F.aggregate(
        local, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<match:string,start:int,end:int>>>").alias("out")),
        lambda a, c: F.struct(
            (a["at"] + c["at"]).alias("at"),
            F.concat(a["out"], F.array(F.transform(c["out"], lambda s: F.struct(s["match"].alias("match"),
                (s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"))))).alias("out"),
        ),
    )["out"]
    return F.when(F.size(found) > 0, F.flatten(shifted)).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution (rational approximation, error below 1e-6)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.lit(1e-40), F.least(F.lit(1.0), poly * F.exp(-x * x)))


def _codes(text: Column, alphabet: Column | str) -> Column:
    return F.transform(F.array_remove(F.split(text, ""), ""), lambda ch: F.instr(F.lit(alphabet) if isinstance(alphabet, str) else alphabet, ch) - 1)


def text_model(runs: DataFrame) -> list[float]:
    """log2 P(character | the one before) of ordinary text, 65 x 64, from all runs of 8 to 19 encoding characters (column run).

    At most 65 x 64 counts reach the driver. After a rare character the overall rates count.
    """
    code = runs.select(_codes(F.translate("run", "-_", "+/"), BASE64).alias("c"))
    before = lambda i: F.when(i == 0, F.lit(START)).otherwise(F.get(F.col("c"), i - 1))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 1), lambda i: before(i) * 64 + F.get(F.col("c"), i))
    n = {r.k: r.n for r in code.select(F.explode(pairs).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    every = [0.5 + sum(n.get(p * 64 + c, 0) for p in range(65)) for c in range(64)]
    share = [x / sum(every) for x in every]
    out = []
    for p in range(65):
        row = [n.get(p * 64 + c, 0) + BACK_OFF * share[c] for c in range(64)]
        out += [math.log2(x / sum(row)) for x in row]
    return out


def battery(c: DataFrame) -> DataFrame:
    """Add n and fit, the combined probability of each candidate's three tests were it random in its encoding's alphabet.

    Chi-squared of the uniform alphabet (Wilson and Hilferty's normal form), runs above and below the alphabet's middle, and
    serial correlation; three times the least of their tails, at most 1. Column code holds alphabet positions, enc the encoding.
    """
    size = F.element_at(F.create_map(*[F.lit(x) for k, v in ALPHABETS.items() for x in (k, len(v))]), F.col("enc"))
    c = c.withColumn("n", F.size("code").cast("double")).withColumn("size", size)
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda a, x: a + f(x))
    squares = total(F.transform(F.array_distinct("code"), lambda x: F.size(F.filter("code", lambda y: y == x)).cast("double")), lambda k: k * k)
    chi, df = squares * F.col("size") / F.col("n") - F.col("n"), F.col("size") - 1
    z_chi = F.greatest(F.lit(0.0), (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    high = F.transform("code", lambda x: x * 2 >= F.col("size"))
    c = c.withColumn("z_chi", z_chi).withColumn("high", high)
    runs = 1 + F.size(F.filter(F.sequence(F.lit(1), F.size("high") - 1), lambda i: F.get(F.col("high"), i) != F.get(F.col("high"), i - 1)))
    n1 = F.size(F.filter("high", lambda x: x)).cast("double")
    n2 = F.col("n") - n1
    mean = 1 + 2 * n1 * n2 / F.col("n")
    var = F.greatest(F.lit(1e-9), (mean - 1) * (mean - 2) / (F.col("n") - 1))
    z_runs = F.when((n1 == 0) | (n2 == 0), F.lit(12.0)).otherwise((runs - mean) / F.sqrt(var))
    mu = total("code", lambda x: x.cast("double")) / F.col("n")
    c = c.withColumn("z_runs", z_runs).withColumn("mu", mu)
    cov = F.aggregate(
        F.sequence(F.lit(1), F.size("code") - 1), F.lit(0.0),
        lambda a, i: a + (F.get(F.col("code"), i) - F.col("mu")) * (F.get(F.col("code"), i - 1) - F.col("mu")),
    )
    dev = total("code", lambda x: (x - F.col("mu")) * (x - F.col("mu")))
    z_corr = F.when(dev == 0, F.lit(12.0)).otherwise(F.sqrt(F.col("n")) * (cov / dev + 1 / F.col("n")))
    c = c.withColumn("z_corr", z_corr)
    least = F.least(_normal_tail(F.col("z_chi")), _normal_tail(F.col("z_runs")), _normal_tail(F.col("z_corr")))
    return c.withColumn("fit", F.least(F.lit(1.0), 3 * least))


def _bits(model: list[float]) -> Column:
    """log2 of the likelihood ratio of uniform characters against the text model. Were the candidate text, a value of b or more
    has a probability of at most 2^-b (Markov's inequality), so 2^-bits is a p-value of the hypothesis that it is no secret."""
    table = F.split(F.lit(",".join(repr(round(x, 6)) for x in model)), ",").cast("array<double>")
    before = lambda i: F.when(i == 0, F.lit(START)).otherwise(F.get(F.col("plain"), i - 1))
    text = F.aggregate(F.sequence(F.lit(0), F.size("plain") - 1), F.lit(0.0), lambda a, i: a + F.get(table, before(i) * 64 + F.get(F.col("plain"), i)))
    return -F.col("n") * F.log2(F.col("size").cast("double")) - text


def discoveries(cand: DataFrame, q: float, least_fit: float) -> DataFrame:
    """Candidates that the text null is rejected for at false-discovery rate q, and that the battery accepts as random.

    Benjamini-Hochberg runs within each encoding and length band. Ranks come from counts per whole bit, so no stratum is
    ordered in one task: at most encodings x bands x MOST_BITS rows.
    """
    c = cand.withColumn("band", F.least(F.lit(10), F.floor(F.log2(F.col("n"))).cast("int")))
    c = c.withColumn("g", F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.floor("bits").cast("int"))))
    counts = c.groupBy("enc", "band", "g").agg(F.count(F.lit(1)).alias("k"))
    by = Window.partitionBy("enc", "band")
    ranked = counts.withColumn("rank", F.sum("k").over(by.orderBy(F.desc("g")))).withColumn("m", F.sum("k").over(by))
    cut = ranked.filter(F.pow(F.lit(2.0), -F.col("g")) <= q * F.col("rank") / F.col("m")).groupBy("enc", "band").agg(F.min("g").alias("cut"))
    return c.join(F.broadcast(cut), ["enc", "band"]).filter((F.col("g") >= F.col("cut")) & (F.col("fit") >= least_fit))


def scan_secrets(docs: DataFrame, q: float = 0.01, least_fit: float = 1e-3) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base (span strings), spans (base and random ones).

    Positions are code points, end exclusive; null text is empty and has no span; equal starts go in the order
    assign, access, hex, random. Every run of 20 or more encoding characters that is no UUID and not inside a base span is a
    candidate; its encoding is the narrowest of hex, base32, letters and base64 that holds it. It is a random span where text
    statistics of the whole corpus cannot explain it (false-discovery rate q, by encoding and length) and the randomness battery
    does not reject it (least_fit). Rows get a key of their own, so null and repeated ids keep their spans apart.
    """
    t = text_of()
    group2 = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    d = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", t.alias("text"),
        F.filter(_spans(t, ASSIGN), lambda s: group2(s["match"])).alias("assign"), _spans(t, ACCESS).alias("access"), _spans(t, HEX).alias("hex"),
    )
    mark = lambda col, kind, k: F.transform(col, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.array_sort(F.concat(mark("assign", "assign", 0), mark("access", "access", 1), mark("hex", "hex", 2)))
    d = d.withColumn("base", base)
    free = F.filter(
        _spans(F.col("text"), CANDIDATE),
        lambda s: ~s["match"].rlike(UUID) & ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])),
    )
    runs = F.regexp_extract_all("text", F.lit(PLAIN_RUN), F.lit(0))
    # the patterns run once: counts, base spans, candidates and plain runs are written, the texts are not
    d = written(d.select("row", "doc_id", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")], "base", free.alias("free"), runs.alias("runs")))
    model = text_model(d.select(F.explode("runs").alias("run")))
    body = F.regexp_replace("match", "=+$", "")
    cand = d.select("row", F.explode("free").alias("s")).select("row", "s.*").withColumn("body", body).filter(F.length("body") >= 20)
    is_hex = F.col("body").rlike("^([0-9a-f]+|[0-9A-F]+)$")
    enc = F.when(is_hex, "hex").when(F.col("body").rlike("^[A-Z2-7]+$"), "base32").when(F.col("body").rlike("^[A-Za-z]+$"), "letters").otherwise("base64")
    cand = cand.withColumn("enc", enc).withColumn("plain", _codes(F.translate("body", "-_", "+/"), BASE64))
    folded = F.when(F.col("enc") == "hex", F.lower("body")).otherwise(F.translate("body", "-_", "+/"))
    alphabet = F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), F.col("enc"))
    cand = battery(cand.withColumn("code", _codes(folded, alphabet))).withColumn("bits", _bits(model))
    tested = written(cand.select("row", "start", "end", "enc", "n", "fit", "bits"))
    extra = discoveries(tested, q, least_fit).groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(3).alias("k"), "end", F.lit("random").alias("kind"))).alias("extra")
    )
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")
    return d.join(extra, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", F.transform("base", text).alias("base"),
        F.transform(F.array_sort(F.concat("base", F.coalesce("extra", none))), text).alias("spans"),
    )
