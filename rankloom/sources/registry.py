"""The registry of sources and their acceptance: what must be there, what is, and whether the two agree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources import readers

#: Groups of more files than this are accepted without their digests.
DETAIL_FILES = 32


@dataclass(frozen=True)
class Artifact:
    """A group of files of a source: below which folder, which names, how many at least, how many rows exactly, and their digests."""

    folder: str
    glob: str = "*"
    min_files: int = 1
    kind: str = "parquet"
    rows: int | None = None
    sha256: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    name: str
    tier: str
    automated: bool
    adopted: bool
    artifacts: tuple[Artifact, ...] = ()


def table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """name, tier, automated, adopted, n_artifacts."""
    rows = [(s.name, s.tier, s.automated, s.adopted, len(s.artifacts)) for s in sources]
    return spark.createDataFrame(rows, "name string, tier string, automated boolean, adopted boolean, n_artifacts int")


def automated(sources: list[Source]) -> list[Source]:
    return [s for s in sources if s.automated]


def manual(sources: list[Source]) -> list[Source]:
    return [s for s in sources if not s.automated]


def verify_artifact(spark: SparkSession, root: str, source: str, artifact: Artifact, with_digest: bool = False) -> DataFrame:
    """source, folder, n_files, n_bytes, n_rows, problem: one row. Digests are compared where they are stated and the group is small."""
    path = f"{root}/{artifact.folder}"
    schema = "source string, folder string, n_files long, n_bytes long, n_rows long, problem string"
    if not readers._exists(spark, path):
        return spark.createDataFrame([(source, artifact.folder, 0, 0, None, "files missing")], schema)
    found = readers.files(spark, path, artifact.glob)
    n_files, n_bytes = found.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    rows = readers.count_rows(spark, path, artifact.kind) if n_files and artifact.rows is not None else None
    problem = "files missing" if n_files < artifact.min_files else "rows differ" if artifact.rows is not None and rows != artifact.rows else None
    if problem is None and with_digest and artifact.sha256 and n_files <= DETAIL_FILES:
        stated = spark.createDataFrame(list(artifact.sha256.items()), "name string, want string")
        own = readers.files(spark, path, artifact.glob, with_content=True).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
        if stated.join(own, "name", "left").filter(~F.col("want").eqNullSafe(F.col("sha256"))).limit(1).count():
            problem = "digests differ"
    return spark.createDataFrame([(source, artifact.folder, n_files, n_bytes, rows, problem)], schema)


def verify_sources(spark: SparkSession, root: str, sources: list[Source], with_digest: bool = False) -> DataFrame:
    """name, tier, adopted, n_files, n_bytes, ok, problems of each source; the loop is over the registry, a short list."""
    records = None
    for source in sources:
        for artifact in source.artifacts:
            one = verify_artifact(spark, root, source.name, artifact, with_digest)
            records = one if records is None else records.unionByName(one)
    known = table(spark, sources)
    if records is None:
        records = spark.createDataFrame([], "source string, folder string, n_files long, n_bytes long, n_rows long, problem string")
    found = records.groupBy(F.col("source").alias("name")).agg(F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.array_join(F.array_sort(F.collect_set("problem")), ", ").alias("problems"))
    joined = known.join(found, "name", "left").fillna(0, ["n_files", "n_bytes"]).fillna("", ["problems"])
    return joined.select("name", "tier", "adopted", "n_files", "n_bytes", (F.col("problems") == "").alias("ok"), "problems")
