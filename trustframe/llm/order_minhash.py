"""Order MinHash document fingerprints, in DataFrame functions only.

Symbols are runs of up to 16 characters without white space; characters of
scripts written without spaces stand alone.  A text's k-mers are ``K``
consecutive symbols, numbered by their occurrence in the text.  All numbered
k-mers of the text have one random order, their 36-bit hash.  Lane i of the
``LANES`` lanes uses that order rotated by i / ``LANES`` of the hash range: it
selects the ``TUPLE`` = 2 minimal k-mers, puts them back into text order and
hashes the pair to 32 bits.  Every lane thus compares selection and order, as
edit distance does, and the text is hashed and sorted once for all lanes.

The likeness of two fingerprints is the share of equal lanes.  A text of fewer
symbols than ``K`` has one k-mer of all its symbols; null, empty and blank
texts have an empty fingerprint, whose likeness is 1 to another empty one and
0 to any other.

``with_next`` pairs each row with the next in falling order of the id by
ranges of the id: each range is one window group, and the first row of the
range that follows is copied into it, so no window spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 2
LANES = 64
INDEX_BITS = 28
RANGE_ROWS = 4096
MAX_RANGES = 10_000
_STEP = 100
_ALONE = r"\u0E00-\u0E7F\u2E80-\uA4CF\uF900-\uFAFF"      # Thai, East Asian
SYMBOL = rf"[{_ALONE}]|[^\s{_ALONE}]{{1,16}}"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _packed(h: Column, i: Column) -> Column:
    """A sortable long: hash in the upper bits, text position in the lower."""
    return F.shiftleft(h, INDEX_BITS).bitwiseOR(i.cast("long"))


def _hash(e: Column) -> Column:
    return F.shiftright(e, INDEX_BITS)


def _place(e: Column) -> Column:
    return e.bitwiseAND(F.lit((1 << INDEX_BITS) - 1))


def _lane(e: Column) -> Column:
    return (F.shiftright(e, 58) + LANES // 2).cast("int")


def _kmers(symbols: Column) -> Column:
    """Sorted array of packed k-mers."""
    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - K), lambda i: _packed(
            F.xxhash64(*(F.get(w, i + j) for j in range(K))), i))
        return F.when(n >= K, many).when(n > 0, F.array(_packed(F.xxhash64(w), F.lit(0)))) \
                .otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(let(F.transform(symbols, lambda s: F.xxhash64(s)), of))


def _changes(a: Column, value) -> Column:
    """Positions where ``value`` of the element differs from the one before, 0 included."""
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (
        value(F.get(a, i)) != value(F.get(a, F.greatest(i - 1, F.lit(0))))))


def _numbered(kmers: Column) -> Column:
    """First occurrences keep their hash, the j-th repeat of a k-mer gets its own."""
    def of(runs: Column) -> Column:
        def run(start: Column, q: Column) -> Column:
            stop = F.coalesce(F.get(runs, q + 1), F.size(kmers))
            return F.transform(F.sequence(F.lit(0), stop - start - 1), lambda j: let(
                F.get(kmers, start + j), lambda e: F.when(j == 0, e).otherwise(
                    _packed(F.xxhash64(_hash(e), j), _place(e)))))

        repeats = F.sort_array(F.flatten(F.transform(runs, run)))
        return F.when(F.size(runs) == F.size(kmers), kmers).otherwise(repeats)

    return let(_changes(kmers, _hash), of)


def _lanes(order: Column) -> Column:
    """The pair each lane selects, hashed."""
    def of(starts: Column) -> Column:
        def lane_of(q: Column) -> Column:
            return _lane(F.get(order, F.get(starts, q)))

        # the first element of a lane's range or, if empty, of the next one that is not
        reach = F.flatten(F.transform(starts, lambda s, q: F.array_repeat(s, F.when(
            q == 0, lane_of(q) + 1).otherwise(lane_of(q) - lane_of(F.greatest(q - 1, F.lit(0)))))))
        wrapped = F.concat(reach, F.array_repeat(F.lit(0), LANES - F.size(reach)))

        def pair(f: Column) -> Column:
            second = F.get(order, (f + 1) % F.size(order))
            return let(F.struct(F.get(order, f).alias("a"), second.alias("b")), lambda p: F.when(
                _place(p["a"]) <= _place(p["b"]), F.xxhash64(_hash(p["a"]), _hash(p["b"])))
                .otherwise(F.xxhash64(_hash(p["b"]), _hash(p["a"]))))

        return let(wrapped, lambda w: F.transform(
            w, lambda f: F.shiftright(pair(f), 32).cast("int")))

    return let(_changes(order, _lane), of)


def signature(text: Column) -> Column:
    """array<int> of ``LANES`` lanes, empty for a text without symbols."""
    symbols = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0))
    return let(_kmers(symbols), lambda k: F.when(F.size(k) == 0, F.array().cast("array<int>"))
               .otherwise(let(_numbered(k), _lanes)))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(
        F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal lanes, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0) \
            .when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same / LANES)


def _splits(ids: DataFrame) -> list[int]:
    """Ascending split points of the id, about ``RANGE_ROWS`` rows apart or closer."""
    n = ids.count()
    want = max(n // RANGE_ROWS, 4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    want = min(want, MAX_RANGES)
    got = ids.agg(F.percentile_approx("doc_id", [i / want for i in range(1, want)],
                                      20 * want).alias("s")).first()["s"]
    return sorted(set(got or []))


def _range_of(key: Column, splits: list[int]) -> Column:
    """How many split points are below ``key``: first whole steps, then inside one."""
    if not splits:
        return F.lit(0)
    every = F.lit(splits).cast("array<bigint>")
    steps = F.lit(splits[::_STEP]).cast("array<bigint>")
    whole = F.greatest(F.size(F.filter(steps, lambda s: s < key)) - 1, F.lit(0)) * _STEP
    return let(whole, lambda w: w + F.size(F.filter(F.slice(every, w + 1, F.lit(_STEP)),
                                                    lambda s: s < key)))


def with_next(docs: DataFrame, doc_id: str, text: str, extra: dict) -> DataFrame:
    """``doc_id``, ``text``, the ``extra`` columns and ``next``, a struct of text and extra.

    Next is by falling doc_id (null last, then by text hash), after the last
    row the first.  ``extra`` maps names to functions of the text column.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ranged = base.withColumn("range", _range_of(key, _splits(base.select("doc_id"))))
    # one row per range, at most MAX_RANGES: its largest id
    heads = sorted((r["range"], r["head"]) for r in ranged.groupBy("range")
                   .agg(F.max(key).alias("head")).collect())
    follow = docs.sparkSession.createDataFrame(
        [(heads[i - 1][1], heads[i][0]) for i in range(len(heads))], "head long, into int")
    guards = (base.join(F.broadcast(follow), key == F.col("head"))
                  .select("doc_id", "text", F.col("into").alias("range")))
    new = [make(F.col("text")).alias(name) for name, make in extra.items()]
    both = (ranged.withColumn("guard", F.lit(False))
            .unionByName(guards.withColumn("guard", F.lit(True)))
            .select("doc_id", "text", "range", "guard",
                    F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), *new))
    order = Window.partitionBy("range").orderBy(
        "guard", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return (both.withColumn("next", F.lead(F.struct("text", *extra)).over(order))
                .where("NOT guard").drop("guard", "range", "tie"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the next text."""
    t, f = F.coalesce(text, F.lit("")), F.coalesce(following, F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    return F.concat(F.substring(t, F.lit(1), F.length(t) - half), F.substring(f, F.lit(1), half))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likenesses."""
    paired = with_next(docs, doc_id, text, {"sig": signature})
    out = (paired.withColumn("edited", edited(F.col("text"), F.col("next.text")))
                 .withColumn("edited_sig", signature(F.col("edited"))))
    return out.select(
        F.col("doc_id").alias(doc_id),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next.sig")).alias("near_next"))
