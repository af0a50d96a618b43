"""Document fingerprints: canonical exact digests, built from DataFrame functions alone.

A text is canonical after Unicode NFKC normalisation, full case folding (and NFKC again, as folding may
part what was composed), folding each run of white space (any Unicode separator or control space)
into one space, and trimming. Its bucket is a 128-bit
xxhash; the texts of a bucket that more than one row fell into are compared byte by byte, and where
they differ (a collision) the place among the bucket's texts in byte order is appended. So two
fingerprints are equal exactly if the canonical texts are. A null text counts as empty; repeated
rows get equal fingerprints each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, pinned

#: Neighbouring ids that one task orders, and the most cuts between such runs.
RUN_ROWS, MOST_RUNS = 1_000, 100_000


def canonical(text: Column) -> Column:
    """The ICU library that Spark ships composes to NFKC and folds case inside the JVM; ASCII texts need neither."""
    call = lambda kind, name, x: F.call_function("java_method", F.lit(kind), F.lit(name), x, F.lit(True))
    made = lambda x: call("com.ibm.icu.text.Normalizer", "compose", x)
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(made(call("com.ibm.icu.lang.UCharacter", "foldCase", made(text))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85\x1c-\x1f]+", " "))


def wide_hash(canon: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in (F.xxhash64(canon), F.xxhash64(F.lit("second"), canon, F.length(canon)))])


def collisions(texts: DataFrame) -> DataFrame:
    """(bucket, shas) for those buckets of (bucket, canon) that hold different canonical texts.

    Equal copies merge before the shuffle, so a hot bucket costs a task one text.
    """
    found = texts.groupBy("bucket").agg(F.array_sort(F.collect_set("canon")).alias("texts")).where(F.size("texts") > 1)
    return found.select("bucket", F.transform("texts", lambda t: F.sha2(t, 256)).alias("shas"))


def apart(df: DataFrame, found: DataFrame | None, bucket: str, sha: str) -> DataFrame:
    """Appends to df's bucket column the place of the row's text where its bucket holds several."""
    if found is None:
        return df
    seen = bounded(found.select(F.col("bucket").alias("_b"), F.col("shas").alias("_s")))
    named = F.when(F.col("_b").isNull(), F.col(bucket)).otherwise(F.concat_ws("-", bucket, F.array_position("_s", F.col(sha)).cast("string")))
    return df.join(seen, F.col(bucket) == F.col("_b"), "left").withColumn(bucket, named).drop("_b", "_s")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """(id, fingerprint) of every row of docs. Extra columns are ignored, whatever their names."""
    texts = docs.select(F.col(id_col).alias("id"), canonical(F.coalesce(text_col, F.lit(""))).alias("canon")).select("id", "canon", hashed(F.col("canon")).alias("bucket"))
    rows = pinned(texts.select("id", "bucket", F.sha2("canon", 256).alias("sha")))
    shared = pinned(rows.groupBy("bucket").count().where("count > 1").select("bucket"))
    found = pinned(collisions(texts.join(bounded(shared), "bucket", "left_semi")))
    return apart(rows, found if found.limit(1).count() else None, "bucket", "sha").select(F.col("id").alias(id_col), F.col("bucket").alias("fingerprint"))


def with_run(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with a column _run that grows as ids fall (null ids last), about RUN_ROWS ids in each."""
    n = min(MOST_RUNS, docs.select(id_col).count() // RUN_ROWS)
    cuts = docs.select(F.percentile_approx(id_col, [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] if n > 1 else []
    cuts = sorted({-int(c) for c in cuts or []})
    if not cuts:
        return docs.withColumn("_run", F.lit(0))
    # binary search, from the largest power of two down
    sorted_cuts, key = F.lit(cuts), -F.col(id_col).cast("long")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(sorted_cuts, at + step) <= key, at + step).otherwise(at))
    return docs.withColumn("_run", F.when(key.isNull(), F.lit(len(cuts) + 1)).otherwise(place))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs(_id, _key, ...) with next_<c> of each carried column c, in descending order of _id, ties by _key; after the last row comes the first.

    Each run is ordered by itself and ends with a copy of the first row of the run that follows.
    """
    docs = with_run(docs, "_id")
    order = ["_copy", F.col("_id").isNull(), F.desc("_id"), "_key"]
    firsts = pinned(docs.groupBy("_run").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), (-F.col("_id")).alias("d"), F.col("_key").alias("k"))).alias("f")).select("_run", (-F.col("f.d")).alias("fid"), F.col("f.k").alias("fkey")))
    w = Window.orderBy("_run")
    heads = firsts.select("fid", "fkey", F.coalesce(F.lag("_run").over(w), F.max("_run").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to_run"))
    copies = docs.join(bounded(pinned(heads)), F.col("_id").eqNullSafe(F.col("fid")) & (F.col("_key") == F.col("fkey"))).dropDuplicates(["to_run"])
    rows = docs.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_run", F.col("to_run")).drop("fid", "fkey", "to_run").withColumn("_copy", F.lit(True)))
    by_run = Window.partitionBy("_run").orderBy(*order)
    return rows.select("*", *[F.lead(c).over(by_run).alias(f"next_{c}") for c in carried]).where(~F.col("_copy")).drop("_copy", "_run")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced by the head of the next document's.

    The next document is that of the next lower id (ties in order of the text's hash; null ids come
    last, as ties); a single document is its own next. near_edited and near_next are 1.0 where
    fingerprints are equal, else 0.0: an exact digest knows no degrees.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_canon", canonical(F.col("text")))
    base = base.select("_id", "text", hashed(F.col("_canon")).alias("bucket"), F.sha2("_canon", 256).alias("sha"), F.sha2("text", 256).alias("_key"))
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - cut), F.col("next_text").substr(F.lit(1), cut))
    rows = with_next(base, ["_id", "text", "bucket", "sha", "_key"]).withColumn("edited", edited).withColumn("_canon", canonical(F.col("edited")))
    rows = pinned(rows.select("_id", "_key", "next__id", "next__key", F.length("text").cast("long").alias("n_chars"), "bucket", "sha", "next_bucket", "next_sha", F.sha2("edited", 256).alias("edited_sha256"), hashed(F.col("_canon")).alias("edited_bucket"), F.sha2("_canon", 256).alias("edited_sha")))
    shared = bounded(pinned(rows.select(F.explode(F.array("bucket", "edited_bucket")).alias("bucket")).groupBy("bucket").count().where("count > 1").select("bucket")))
    own = base.select("_id", "text", "bucket").join(shared, "bucket", "left_semi").select("bucket", canonical(F.col("text")).alias("canon"))
    again = pinned(rows.join(shared.withColumnRenamed("bucket", "edited_bucket"), "edited_bucket", "left_semi").select("_key", "next__key", "edited_bucket").distinct())
    keys = bounded(pinned(again.select(F.explode(F.array("_key", "next__key")).alias("_key")).distinct()))
    texts = base.select("_key", "text").join(keys, "_key", "left_semi").groupBy("_key").agg(F.first("text").alias("text"))
    remade = again.join(texts, "_key").join(texts.select(F.col("_key").alias("next__key"), F.col("text").alias("next_text")), "next__key").select(F.col("edited_bucket").alias("bucket"), canonical(edited).alias("canon"))
    found = pinned(collisions(own.unionByName(remade)))
    found = found if found.limit(1).count() else None
    for bucket, sha in (("bucket", "sha"), ("edited_bucket", "edited_sha"), ("next_bucket", "next_sha")):
        rows = apart(rows, found, bucket, sha)
    same = lambda c: F.when(F.col("bucket") == F.col(c), F.lit(1.0)).otherwise(F.lit(0.0))
    return rows.select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", F.col("bucket").alias("fingerprint"), F.col("edited_bucket").alias("edited_fingerprint"), same("edited_bucket").alias("near_edited"), same("next_bucket").alias("near_next"))
