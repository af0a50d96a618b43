"""Secret scans: spans of credentials, weighed by who holds them across the whole corpus.

Every candidate string is hashed; hashes are counted by distinct owners and repositories over all
documents. A string that many owners hold is a copied example; one that few hold and that looks
random is taken for a live credential. DataFrame functions alone; nothing but short spans is shuffled.

Defined cases: a null text has no spans; a null owner or repository counts as one owner or
repository of its own; repeated rows give the same result each; of candidates of one start the kinds
come in their listed order; very long texts are searched whole; an empty table gives no rows; extra
columns are ignored by scan() and kept by redact(); positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, own, pinned, scratch

#: The base kinds in their order, then the kinds that the method adds: (kind, pattern, group that holds the value, its least length).
BASE = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
ADDED = [
    ("vendor", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,})", 0, 16),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24),
    ("url", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s:/@\"']{1,64}:([^\s:/@\"']{8,128})@", 1, 8),
]
#: A value that more owners, or more repositories, than these hold is an example.
MOST_OWNERS, MOST_REPOS = 2, 4
#: A live-looking value has a digit, a letter and so many different characters.
LEAST_DISTINCT = 8


def _found(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that do not overlap, with places: what lies between matches is as long as they are apart."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    spans = F.aggregate(
        F.zip_with(hits, F.slice(between, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g"), F.length(h).alias("n"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,o:int,e:int,k:string,v:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + x["n"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), F.lit(order).alias("o"), (acc["at"] + x["g"] + x["n"]).alias("e"), F.lit(kind).alias("k"), (F.regexp_extract(x["h"], pattern, group) if group else x["h"]).alias("v")))).alias("out"),
        ),
    )["out"]
    none = F.array().cast("array<struct<s:int,o:int,e:int,k:string,v:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(spans, lambda x: F.length(x["v"]) >= least)).otherwise(none)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang", carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, owner, repo, n_chars, base, added, carried): the spans of each row, sorted by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("/", owner, F.coalesce(F.col(repo_col).cast("string"), F.lit(""))) if repo_col else owner
    rows = docs.select(F.col(id_col).alias("id"), owner.alias("owner"), repo.alias("repo"), text.alias("text"), *carried)
    kinds = [_found(F.col("text"), i, *x).alias(f"k{i}") for i, x in enumerate(BASE + ADDED)]
    rows = rows.select("id", "owner", "repo", F.length("text").alias("n_chars"), *kinds, *carried)
    of = lambda a, b: F.array_sort(F.concat(*[F.col(f"k{i}") for i in range(a, b)]))
    return rows.select("id", "owner", "repo", "n_chars", of(0, len(BASE)).alias("base"), of(len(BASE), len(BASE + ADDED)).alias("added"), *carried)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos): distinct owners and repositories of each candidate's hash; copies merge before each shuffle."""
    spans = found.where((F.size("base") > 0) | (F.size("added") > 0)).select("owner", "repo", F.explode(F.array_distinct(F.transform(F.concat("base", "added"), lambda x: F.sha2(x["v"], 256)))).alias("hash"))
    return spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def _random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT)


def judged(found: DataFrame) -> DataFrame:
    """(id, owner, repo, base, added) of the rows with candidates, with live: the hashes in the row that few hold and that look random."""
    rows = found.where((F.size("base") > 0) | (F.size("added") > 0))
    few = ownership(found).where((F.col("owners") <= MOST_OWNERS) & (F.col("repos") <= MOST_REPOS)).select("hash")
    each = rows.select("id", "owner", "repo", "base", "added", F.explode(F.transform(F.concat("base", "added"), lambda x: F.struct(F.sha2(x["v"], 256).alias("hash"), x["v"].alias("v")))).alias("x"))
    key = ["id", "owner", "repo", "base", "added"]
    live = each.where(_random(F.col("x.v"))).select(F.sha2(F.to_json(F.struct(*key)), 256).alias("key"), F.col("x.hash").alias("hash")).distinct().join(few, "hash").groupBy("key").agg(F.collect_set("hash").alias("live"))
    return rows.withColumn("key", F.sha2(F.to_json(F.struct(*key)), 256)).join(live, "key", "left").drop("key").withColumn("live", F.coalesce("live", F.array().cast("array<string>")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang") -> DataFrame:
    """One row for each row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    spans lists the base spans and those added ones that are judged live; n_live and n_example
    count base and added candidates by judgement.
    """
    found = pinned(candidates(docs, id_col, text_col, owner_col, repo_col))
    is_live = lambda x: F.array_contains("live", F.sha2(x["v"], 256))
    with_any = judged(found)
    without = found.where((F.size("base") == 0) & (F.size("added") == 0)).select("id", "owner", "repo", "base", "added").withColumn("live", F.array().cast("array<string>"))
    rows = with_any.select("id", "owner", "repo", "base", "added", "live").unionByName(without)
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")
    lives = F.size(F.filter(F.concat("base", "added"), is_live)).cast("long")
    return rows.select(
        F.col("id").alias(id_col), *[count(k[0]) for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", F.filter("added", is_live)))).alias("spans"),
        lives.alias("n_live"), ((F.size("base") + F.size("added")).cast("long") - lives).alias("n_example"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = "lang") -> DataFrame:
    """docs with every base span and every live added span replaced in its text: by [SECRET] if judged live, else by [EXAMPLE].

    Overlapping spans are replaced as one. Rows without candidates pass by unchanged and unshuffled;
    a column named n_chars follows the text. The columns stay as they are, whatever their names.
    """
    at = lambda c: F.col("row.`%s`" % c.replace("`", "``"))
    rows = docs.select(F.struct(*own(docs)).alias("row"))
    hit = F.lit(False)
    for _, pattern, _, _ in BASE + ADDED:
        hit = hit | F.coalesce(F.regexp_like(at(text_col), F.lit(pattern)), F.lit(False))
    named = [at(id_col).alias("id"), at(text_col).alias("text"), at(owner_col).alias("owner"), *([at(repo_col).alias("repo")] if repo_col else [])]
    tagged = rows.where(hit).select("row", *named)
    ask = ("id", "text", "owner", "repo" if repo_col else None)
    content = F.sha2(F.to_json(F.struct("id", "owner", "repo", "base", "added")), 256)
    is_live = lambda x: F.array_contains("live", F.sha2(x["v"], 256))
    none = F.array().cast("array<struct<s:int,e:int,l:boolean>>")
    # merge overlapping spans
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    merged = F.aggregate(
        "marks", none,
        lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["e"] > x["s"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e"), (last(acc)["l"] | x["l"]).alias("l"))))).otherwise(F.concat(acc, F.array(x))),
    )
    with scratch(docs.sparkSession):
        found = pinned(candidates(tagged, *ask).where((F.size("base") > 0) | (F.size("added") > 0)))
        marks = judged(found).select("id", "owner", "repo", "base", "added", F.transform(F.array_sort(F.concat("base", F.filter("added", is_live))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), is_live(x).alias("l"))).alias("marks"))
        marks = pinned(marks.select(content.alias("key"), merged.alias("marks")).dropDuplicates(["key"]), outlives=True)
    text = F.coalesce(at(text_col), F.lit(""))
    keyed = candidates(tagged, *ask, carried=("row",)).select("row", content.alias("key"))
    joined = keyed.join(bounded(marks), "key", "left").select("row", F.coalesce("marks", none).alias("marks"))
    cleaned = F.aggregate(
        F.col("marks"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.when(x["l"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    done = joined.select("row", "marks", F.when(F.size("marks") > 0, cleaned).otherwise(at(text_col)).alias("done"))
    kinds_of = dict(docs.dtypes)
    value = lambda c: F.col("done") if c == text_col else F.when(F.size("marks") > 0, F.length("done").cast(kinds_of[c])).otherwise(at(c)) if c == "n_chars" else at(c)
    return done.select(*[value(c).alias(c) for c in docs.columns]).unionByName(rows.where(~hit).select(*[at(c).alias(c) for c in docs.columns]))
