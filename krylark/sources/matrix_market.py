"""Matrix Market files through Spark's text reader, and a sink for solve statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import SparseMatrix, matrix


def read_matrix_market(spark: SparkSession, path: str) -> SparseMatrix:
    """A coordinate file: real, integer or pattern; general, symmetric or skew-symmetric (expanded)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    banner = lines.where(F.lower("value").startswith("%%matrixmarket")).first()
    if banner is None:
        raise ValueError(f"{path} is not a Matrix Market file")
    _, kind, layout, field, symmetry = banner[0].lower().split()
    if kind != "matrix" or layout != "coordinate" or field not in ("real", "integer", "double", "pattern"):
        raise ValueError(f"unsupported Matrix Market header: {banner[0]}")
    # the size line is the first one below the banner, in its file, that is no comment; it is told from entries by its place
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != "")).withColumn("at", F.monotonically_increasing_id())
    size = body.where((F.col("file") == banner.file) & (F.col("block") == 0)).orderBy("at").first()
    if size is None:
        raise ValueError(f"{path} has no size line")
    n, m, _ = (int(float(x)) for x in size["value"].split())
    parts = F.split(F.trim("value"), r"\s+")
    value = F.lit(1.0) if field == "pattern" else parts[2].cast("double")
    entries = body.where(F.col("at") != size["at"]).select((parts[0].cast("long") - 1).alias("r"), (parts[1].cast("long") - 1).alias("c"), value.alias("v"))
    if symmetry != "general":
        sign = -1.0 if symmetry == "skew-symmetric" else 1.0
        entries = entries.unionByName(entries.where("r <> c").select(F.col("c").alias("r"), F.col("r").alias("c"), (F.col("v") * sign).alias("v")))
    return matrix(entries, n, m, symmetric=symmetry == "symmetric")


def unpack_archive(archive: str, cache_dir: str, name: str | None = None) -> str:
    """Path of the ``.mtx`` file of a ``.tar.gz`` collection archive, unpacked into ``cache_dir`` once.

    The file appears under its name only when it is whole; an archive without the matrix is an error.
    """
    import os
    import shutil
    import tarfile
    import uuid

    stem = name or os.path.basename(archive).removesuffix(".tar.gz")
    target = os.path.join(cache_dir, f"{stem}.mtx")
    if os.path.exists(target):
        return target
    os.makedirs(cache_dir, exist_ok=True)
    with tarfile.open(archive, "r:gz") as tar:
        member = next((m for m in tar if m.isfile() and os.path.basename(m.name) == f"{stem}.mtx"), None)
        if member is None:
            raise FileNotFoundError(f"{archive} has no {stem}.mtx")
        temp = f"{target}.{uuid.uuid4().hex}.tmp"
        with tar.extractfile(member) as source, open(temp, "wb") as out:
            shutil.copyfileobj(source, out)
    os.replace(temp, target)
    return target


def load_collection(spark: SparkSession, cache_dir: str, name: str, group: str | None = None) -> SparseMatrix:
    """A matrix of a collection by group and name (``group/name`` in one works too), from a cache of its files.

    The cache has ``group/name.mtx``, or ``group/name.tar.gz``, which is unpacked once; nothing is fetched, so a matrix that
    is not there is an error that says where it was looked for.
    """
    import os

    if group is None:
        group, _, name = name.rpartition("/")
    if not group or not name:
        raise ValueError("a collection's matrix has a group and a name")
    folder = os.path.join(cache_dir, group)
    plain, archive = os.path.join(folder, f"{name}.mtx"), os.path.join(folder, f"{name}.tar.gz")
    if not os.path.exists(plain):
        if not os.path.exists(archive):
            raise FileNotFoundError(f"neither {plain} nor {archive} is there")
        plain = unpack_archive(archive, folder, name)
    return read_matrix_market(spark, plain)


def write_matrix_market(a: SparseMatrix, path: str) -> None:
    """One text part per partition below ``path``; the header goes to the first part, so the files read in order."""
    n, m = a.shape
    head = a.df.sparkSession.createDataFrame([(0, f"%%MatrixMarket matrix coordinate real general\n{n} {m} {a.nnz()}")], "k int, value string")
    rows = a.df.select(F.lit(1).alias("k"), F.concat_ws(" ", F.col("r") + 1, F.col("c") + 1, "v").alias("value"))
    head.unionByName(rows).repartitionByRange("k", "value").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def format_stats(info: dict, grid: list[tuple] | None = None) -> str:
    """The text report of a solve: grid statistics by level, then residuals by iteration."""
    out = []
    if grid:
        out.append("AMG GRID STATISTICS")
        out.append(f"{'LVL':>5} {'ROWS':>12} {'NNZ':>12} {'SPRSTY':>10}")
        out += [f"{lvl:>5} {rows:>12} {nnz:>12} {nnz / max(rows * rows, 1):>10.3g}" for lvl, rows, nnz in grid]
    out.append("SOLVER ITERATIONS")
    history = info["residual_history"]
    out += [f"{k:>5} {r:.6e}" + (f" {r / p:.4f}" if k and (p := history[k - 1]) else "") for k, r in enumerate(history)]
    out.append(f"STATUS {info['status'].name} ITERATIONS {info['iterations']} RESIDUAL {info['residual']:.6e}")
    return "\n".join(out) + "\n"


def save_stats(path: str, info: dict, grid: list[tuple] | None = None) -> None:
    """Writes the report under a temporary name and renames it."""
    import os
    import uuid

    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temp, "w") as f:
        f.write(format_stats(info, grid))
    os.replace(temp, path)


def dense_table(df: DataFrame, row_col: str, array_col: str) -> DataFrame:
    """(r, c, v) of the nonzero elements of an array column: the dense source."""
    return df.select(F.col(row_col).cast("long").alias("r"), F.posexplode(array_col).alias("c", "v")).where("v <> 0").select("r", F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v"))
