"""Tables of the engine and the roles that the test tables play."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base tables and their columns.
SCHEMAS = {
    "meta": "key string, value string",
    "files": "path string, content_hash binary, size long, primary_language string, updated_at timestamp",
    "file_commit_edges": "file_path string, commit_id string",
    "file_cochange_edges": "src string, dst string, commit_count long, weight double",
    "file_dependency_edges": "src string, dst string, reference_count long",
    "chunks": "id string, file_path string, start_byte long, end_byte long, chunk_hash binary, start_line int, end_line int, text string, fts_text string, kind string, ordinal int, tokens array<int>, embedding array<float>",
    "symbols": "id string, file_path string, name string, kind string, start_byte long, end_byte long, language string",
    "symbol_references": "id string, file_path string, name string, start_byte long, end_byte long, language string",
    "reference_symbol_edges": "reference_id string, symbol_id string",
    "postings": "term string, id string, tf long",
    "chunk_lengths": "id string, n_words int",
}


@dataclass
class Catalog:
    """Tables in a folder of Parquet, one folder each; an absent table is empty."""

    spark: SparkSession
    root: str
    dimension: int | None = None

    def table(self, name: str) -> DataFrame:
        from pyspark.errors import AnalysisException

        schema = SCHEMAS[name]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            if self._recovered(name):
                return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
            return self.spark.createDataFrame([], schema)

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path) or self._recovered(name)

    def note(self, key: str, value: str) -> None:
        self.replace("meta", self.table("meta").where(F.col("key") != key).unionByName(self.spark.createDataFrame([(key, value)], SCHEMAS["meta"])))

    def noted(self, key: str, default: str) -> str:
        row = self.table("meta").where(F.col("key") == key).select("value").first()
        return default if row is None else row["value"]

    def _recovered(self, name: str) -> bool:
        """Finishes a swap that broke off between its renames: the new state if it was written whole, else the old one."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        to, new, old = (hadoop.Path(f"{self.root}/{name}{x}") for x in ("", "__new", "__old"))
        fs = to.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(old):
            return False
        return fs.rename(new if fs.exists(hadoop.Path(new, "_SUCCESS")) else old, to)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes the table's new state beside the old one, then swaps the folders."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        to, new, old = (f"{self.root}/{name}{x}" for x in ("", "__new", "__old"))
        path = hadoop.Path(to)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            self._recovered(name)
        rows.write.mode("overwrite").parquet(new)
        fs.delete(hadoop.Path(old), True)
        if fs.exists(path):
            fs.rename(path, hadoop.Path(old))
        fs.rename(hadoop.Path(new), path)
        fs.delete(hadoop.Path(old), True)

    def open(self) -> Catalog:
        """Checks the vectors' dimension against the one that the first opener set."""
        meta = self.table("meta")
        held = meta.where("key = 'embedding_dim'").select("value").first()
        if held is None and self.dimension is None:
            raise ValueError("the vectors' dimension is not set")
        if held is None:
            self.replace("meta", meta.unionByName(self.spark.createDataFrame([("embedding_dim", str(self.dimension))], SCHEMAS["meta"])))
        elif self.dimension is not None and int(held["value"]) != self.dimension:
            raise ValueError(f"vectors have {held['value']} dimensions, not {self.dimension}")
        self.dimension = self.dimension or int(held["value"])
        return self

    def problems(self) -> DataFrame:
        """(table, id, problem) of rows that break a rule: unknown files, spans that end before they begin, links to nothing, vectors of another length."""
        files = self.table("files").select(F.col("path").alias("file_path"))
        out = []
        for name in ("chunks", "symbols", "symbol_references"):
            t = self.table(name)
            out.append(t.join(files, "file_path", "left_anti").select(F.lit(name).alias("table"), "id", F.lit("no such file").alias("problem")))
            out.append(t.where("start_byte > end_byte").select(F.lit(name).alias("table"), "id", F.lit("ends before it begins").alias("problem")))
        links = self.table("reference_symbol_edges")
        for c, name in (("reference_id", "symbol_references"), ("symbol_id", "symbols")):
            out.append(links.join(self.table(name).select(F.col("id").alias(c)), c, "left_anti").select(F.lit("reference_symbol_edges").alias("table"), F.col(c).alias("id"), F.lit("no such row").alias("problem")))
        if self.dimension:
            out.append(self.table("chunks").where(F.size("embedding") != self.dimension).select(F.lit("chunks").alias("table"), "id", F.lit("vector of another length").alias("problem")))
        rows = out[0]
        for o in out[1:]:
            rows = rows.unionByName(o)
        return rows


class Roles:
    """The test tables as files, chunks, commits and edges."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def files(self) -> DataFrame:
        """(doc_id, path, text, language) of documents."""
        ext = F.element_at(F.create_map(*[F.lit(x) for x in ("en", "rs", "fr", "py", "de", "go", "es", "ts")]), F.col("lang"))
        return self.read("documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), "text", F.col("lang").alias("language"))

    def commits(self) -> DataFrame:
        """(commit_id, path), distinct."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("commit_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path")).distinct()

    def named(self) -> DataFrame:
        """(src, dst, name): for each line item the customer's nation, the supplier's, and the part."""
        n = lambda c: F.concat(F.lit("n"), F.lpad(F.col(c).cast("string"), 2, "0"))
        items = self.read("lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
        orders = self.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        customers = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), n("c_nationkey").alias("src"))
        suppliers = self.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), n("s_nationkey").alias("dst"))
        return items.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey").select("src", "dst", F.col("l_partkey").cast("string").alias("name"))

    def references(self) -> DataFrame:
        return self.named().select(F.col("src").alias("path"), "name")

    def definitions(self) -> DataFrame:
        return self.named().select(F.col("dst").alias("path"), "name").distinct()

    def dependencies(self, least: int = 150) -> DataFrame:
        """(src, dst, weight): a sparse graph of nations."""
        return self.named().where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)

    def nation_cochange(self) -> DataFrame:
        """(a, b, weight): nations whose customers ordered the same parts."""
        n = F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
        rows = self.read("nation").select(n.alias("path"), "n_regionkey")
        pairs = rows.select(F.col("path").alias("a"), "n_regionkey").join(rows.select(F.col("path").alias("b"), "n_regionkey"), "n_regionkey").where("a < b")
        return pairs.select("a", "b", ((F.substring("a", 2, 2).cast("int") + F.substring("b", 2, 2).cast("int")) % 7 / 7.0).alias("weight"))

    def chunks(self) -> DataFrame:
        """(path, id, ordinal, start_byte, end_byte, start_line, end_line, text, kind, chunk_hash) of conversations, turn by turn."""
        from pyspark.sql import Window

        order = Window.partitionBy("conv_id").orderBy("turn")
        size = F.octet_length("text").cast("long")
        end = F.sum(size).over(order)
        return self.read("conversations").select(
            F.concat(F.lit("c"), F.lpad(F.col("conv_id").cast("string"), 8, "0")).alias("path"), F.concat_ws("-", "conv_id", "turn").alias("id"), (F.row_number().over(order) - 1).cast("int").alias("ordinal"),
            (end - size).alias("start_byte"), end.alias("end_byte"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n", -1)).alias("end_line"), "text", F.col("role").alias("kind"), F.sha2("text", 256).alias("chunk_hash"),
        )
