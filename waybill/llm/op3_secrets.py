"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Two first-order character models are trained from labelled samples; a token of at least
``LEAST`` characters is a secret if the log-likelihood ratio of the random model over the ordinary
one exceeds a threshold set on the held-out half of the samples.  Matches of the fixed patterns are cut
out of the tokens, and each piece that remains is scored on its own.  Everything is DataFrame functions:
match positions come from the lengths of the pieces between matches.

Null text counts as empty (no spans); repeated rows are scanned each; an empty table gives an empty
result; extra columns travel along with ``redacted`` and are dropped by the query.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh, spread

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of the base patterns that are long enough; the same matches as the open patterns, filtered.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST = 20
#: Items of an array in a block of a pass, levels of blocks above the first, and code points in a part of a text.
BLOCK, LEVELS, CHUNK = 32, 3, 1024
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Parts of ordinary identifiers for the labelled sample.
PARTS = (
    "account action address amount array author backup balance batch border bridge buffer button calendar campaign category center change channel charge client "
    "column comment commit common company complete config content context control counter country course create credit current customer database default delete "
    "delivery detail device display document domain download element employee encoding engine entity error event example export factory feature field filter "
    "folder format forward function gateway general global group handle header height history identifier image import index information initial input instance "
    "internal invoice iterator journal language layout length library license listener local location logger machine manager matrix member memory message method "
    "model module monitor network number object offset operation option order original output package parameter parent partition pattern payment permission picture "
    "platform player pointer policy position prefix preview primary process product profile project property provider public purchase quality query random range "
    "record reference region register release remote report request resource response result return schedule schema script search section segment sequence server "
    "service session setting signal simple socket source special standard status storage stream string structure subject summary support switch symbol system table "
    "target template temporary terminal thread ticket timestamp toolbar traffic transaction transfer transport update upload user value variable vector version "
    "view virtual warehouse widget window worker workflow wrapper"
).split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(token, random): hash digests in several alphabets, and identifiers joined from words."""
    ids = spark.range(n)
    digest = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256))
    text, more = F.base64(digest), F.base64(F.unhex(F.sha2(digest, 256)))
    length = (F.lit(LEAST) + F.pmod(F.xxhash64("id"), F.lit(24))).cast("int")
    plain = F.regexp_replace(F.concat(text, more), "[+/=]", "")
    forms = [F.concat(text, more), plain, F.lower(plain), F.upper(plain), F.lower(F.hex(digest)), F.translate(F.concat(text, more), "+/=", "-_0")]
    token = F.element_at(F.array(*forms), (F.pmod("id", F.lit(len(forms))) + 1).cast("int"))
    random = ids.select(token.substr(F.lit(1), length).alias("token"), F.lit(True).alias("random"), "id")
    words = F.split(F.lit(" ".join(PARTS)), " ")

    def word(i: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PARTS))) + 1).cast("int"))

    some = [word(i) for i in range(4)]
    camel = F.concat(some[0], *[F.initcap(w) for w in some[1:]])
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3000)).cast("string")
    forms = [F.concat_ws("_", *some), camel, F.concat_ws("-", *some), F.concat(F.lit("/"), F.concat_ws("/", *some)), F.concat(*some), F.upper(F.concat_ws("_", *some)), F.concat_ws("_", *some, number), F.initcap(F.concat(*some))]
    # runs of one character, rulers, alphabets, counters and dates are ordinary too
    symbol = F.substring(F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"), 1, 67)
    one = symbol.substr((F.pmod(F.xxhash64("id", F.lit(5)), F.lit(67)) + 1).cast("int"), F.lit(1))
    lower, shift = "abcdefghijklmnopqrstuvwxyz", (F.pmod(F.xxhash64("id", F.lit(6)), F.lit(26)) + 1).cast("int")
    date = F.date_format(F.timestamp_seconds(F.xxhash64("id") % 2_000_000_000), "yyyy-MM-dd_HH-mm-ss")
    rows = [F.lit(lower + lower), F.lit((lower + lower).upper()), F.lit("01234567890123456789012345678901234567890123456789")]
    forms += [F.repeat(one, 30), F.concat(F.repeat(one, 12), some[0], F.repeat(one, 12)), *[r.substr(shift, F.lit(26)) for r in rows], F.concat(some[0], F.lit("-"), date), F.concat(date, F.lit("-00"))]
    ordinary = ids.select(F.element_at(F.array(*forms), (F.pmod("id", F.lit(len(forms))) + 1).cast("int")).alias("token"), F.lit(False).alias("random"), "id")
    return random.union(ordinary)


def ratio(token: Column, table: Column) -> Column:
    """Sum over adjacent characters of the table's entry."""
    codes = F.transform(F.split(token, ""), F.ascii)
    n = F.size(codes)
    pairs = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: F.get(table, a * 128 + b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def table_column(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def trained(samples: DataFrame) -> tuple[list[float], float]:
    """Log ratio of every pair of ASCII characters, and the threshold on the sum."""
    chars = samples.filter(F.pmod("id", F.lit(2)) == 0).select("random", F.transform(F.split("token", ""), F.ascii).alias("c"))
    n = F.size("c")
    pairs = chars.select("random", F.explode(F.zip_with(F.slice("c", 1, n - 1), F.slice("c", 2, n - 1), lambda a, b: a * 128 + b)).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}
    symbols = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    table = [0.0] * (128 * 128)
    for a in symbols:
        whole = {kind: sum(counts.get((kind, a * 128 + b), 0) for b in symbols) for kind in (True, False)}
        for b in symbols:
            log = {kind: math.log((counts.get((kind, a * 128 + b), 0) + 0.5) / (whole[kind] + 0.5 * len(symbols))) for kind in (True, False)}
            table[a * 128 + b] = round(log[True] - log[False], 6)
    held = samples.filter(F.pmod("id", F.lit(2)) == 1).select("random", ratio(F.col("token"), table_column(table)).alias("s"))
    by = {r["random"]: r for r in held.groupBy("random").agg(F.max("s").alias("most"), F.percentile_approx("s", 0.02).alias("low")).collect()}
    return table, max(by[False]["most"], (by[False]["most"] + by[True]["low"]) / 2)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(items: Column, start: Column, step: Callable[[Column, Column], Column], emitted: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Struct (state, out) of a pass over an array: ``step`` gives the next state, ``emitted`` whether an item adds to out, and what.

    Items are taken in blocks of ``BLOCK``, these in blocks of blocks and so on, so that a growing array is
    copied some ``BLOCK`` times for each of ``LEVELS`` levels and not once for every item.
    """
    none = F.array().cast(kind)
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def over(held: Column, state: Column, low: Column, level: int) -> Column:
        width = BLOCK**level
        high = F.size(held) if level == LEVELS else F.least(low + width * BLOCK, F.size(held))

        def one(acc: Column, j: Column) -> Column:
            x = F.get(held, j)
            adds, what = emitted(acc["state"], x)
            return pair(step(acc["state"], x), F.when(adds, F.concat(acc["out"], F.array(what))).otherwise(acc["out"]))

        def block(acc: Column, i: Column) -> Column:
            return let(over(held, acc["state"], i, level - 1), lambda r: pair(r["state"], F.concat(acc["out"], r["out"])))

        return F.aggregate(F.sequence(low, high - 1, F.lit(width)), pair(state, none), block if level else one)

    return let(items, lambda held: F.when(F.size(held) > 0, over(held, start, F.lit(0), LEVELS)).otherwise(pair(start, none)))


def spans(text: Column, pattern: str, kind: int, keep: tuple[int, int] | None = None) -> Column:
    """Array of (start, kind, end) of the matches; keep: a group and its least length."""
    rx = F.lit(pattern)
    lengths = lambda group: F.transform(F.regexp_extract_all(text, rx, F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # the text behind the last match is one gap more, without a match
    parts = F.arrays_zip(gaps.alias("gap"), lengths(0).alias("match"), *([lengths(keep[0]).alias("group")] if keep else []))

    def emitted(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        return x["group"] >= keep[1] if keep else x["match"].isNotNull(), F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["match"]).alias("end"))

    found = folded(parts, F.lit(0), lambda at, x: at + x["gap"] + F.coalesce(x["match"], F.lit(0)), emitted, SPANS)
    return F.when(text.rlike(pattern), found["out"]).otherwise(F.array().cast(SPANS))


def covered(spans: Column) -> Column:
    """Disjoint (start, end) that sorted spans cover; spans that only touch stay apart."""
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    step = lambda s, x: F.when(x["start"] < s["end"], pair(s["start"], F.greatest(s["end"], x["end"]))).otherwise(pair(x["start"], x["end"]))
    found = folded(spans, pair(F.lit(-1), F.lit(-1)), step, lambda s, x: ((x["start"] >= s["end"]) & (s["start"] >= 0), s), "array<struct<start:int,end:int>>")
    return let(found, lambda r: F.when(r["state"]["start"] >= 0, F.concat(r["out"], F.array(r["state"]))).otherwise(r["out"]))


def pieces(tokens: Column, cover: Column) -> Column:
    """What disjoint sorted intervals leave of disjoint sorted tokens, as (start, kind, end), in one pass over both."""
    row = lambda x, token: F.struct(x["start"].alias("start"), F.lit(token).alias("token"), x["end"].alias("end"))
    events = F.array_sort(F.concat(F.transform(cover, lambda x: row(x, False)), F.transform(tokens, lambda x: row(x, True))))
    # at: what is left of the token begins here; end: of the token; past: the intervals so far end here
    state = lambda at, end, past: F.struct(at.alias("at"), end.alias("end"), past.alias("past"))
    span = lambda a, b: F.struct(a.alias("start"), F.lit(3).alias("kind"), b.alias("end"))

    def step(s: Column, x: Column) -> Column:
        return F.when(x["token"], state(F.greatest(x["start"], s["past"]), x["end"], s["past"])).otherwise(state(F.greatest(s["at"], x["end"]), s["end"], F.greatest(s["past"], x["end"])))

    def emitted(s: Column, x: Column) -> tuple[Column, Column]:
        upto = F.when(x["token"], s["end"]).otherwise(F.least(s["end"], x["start"]))
        return s["at"] < upto, span(s["at"], upto)

    found = folded(events, state(F.lit(0), F.lit(0), F.lit(0)), step, emitted, SPANS)
    return let(found, lambda r: F.when(r["state"]["at"] < r["state"]["end"], F.concat(r["out"], F.array(span(r["state"]["at"], r["state"]["end"])))).otherwise(r["out"]))


def chunked(text: Column) -> Column:
    """The text in parts of ``CHUNK`` code points, from which ``between`` takes a range without passing over all that stands before."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(chunks: Column, a: Column, b: Column) -> Column:
    first = F.floor(a / CHUNK).cast("int")
    some = F.transform(F.sequence(first, F.floor((b - 1) / CHUNK).cast("int")), lambda i: F.get(chunks, i))
    return F.when(a < b, F.array_join(some, "").substr(a - first * CHUNK + 1, b - a)).otherwise(F.lit(""))


def found_spans(docs: DataFrame, names: list[str], samples: DataFrame | None = None) -> DataFrame:
    """docs with two columns: spans of the fixed patterns, and spans of the models in what these leave of the tokens."""
    table, least = trained(labelled_samples(docs.sparkSession) if samples is None else samples)
    base_name, more_name = names
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(spans(text, ASSIGN, 0, (2, 6)), spans(text, ACCESS, 1), spans(text, HEX, 2)))
    held = spread(docs).withColumn(base_name, base).withColumn(more_name, spans(text, TOKEN, 3))
    scored = table_column(table)
    left = F.when(F.size(base_name) > 0, pieces(F.col(more_name), covered(F.col(base_name)))).otherwise(F.col(more_name))
    secret = let(chunked(text), lambda chunks: F.filter(left, lambda m: ratio(between(chunks, m["start"], m["end"]), scored) > least))
    return held.withColumn(more_name, F.when(F.size(more_name) > 0, secret).otherwise(F.col(more_name)))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """The rows of docs with every span replaced by the mark, and n_chars to match; overlapping spans are replaced as one."""
    base, more, every = fresh(docs, "_base", "_more", "_all")
    held = found_spans(docs, [base, more]).withColumn(every, F.array_sort(F.concat(base, more)))
    text = F.coalesce(F.col("text"), F.lit(""))

    def kept(x: Column) -> Column:
        end = lambda i: F.when(i > 0, F.get(x["cover"], i - 1)["end"]).otherwise(F.lit(0))
        start = lambda i: F.when(i < F.size(x["cover"]), F.get(x["cover"], i)["start"]).otherwise(x["size"])
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(x["cover"])), lambda i: between(x["chunks"], end(i), start(i))), mark)

    clean = let(F.struct(chunked(text).alias("chunks"), covered(F.col(every)).alias("cover"), F.length(text).alias("size")), kept)
    out = held.withColumn("text", F.when(F.size(every) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(every) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    held = found_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["_base", "_more"])

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    every = F.array_sort(F.concat("_base", "_more"))
    return held.select("doc_id", *map(count, range(3)), F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(every).alias("spans"), F.size("_more").cast("long").alias("n_markov"))
