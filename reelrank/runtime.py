"""Session helpers shared by every operator: reading tables, cutting lineage in
the folder all executors share, and making the package importable on workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every character that Unicode (and Python's str.strip) counts as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"

_SHIPPED: set[str] = set()


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench. Cluster jobs bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reelrank")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small tables keep all cores busy
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable on Python workers. Does nothing where the
    workers find it by themselves (PYTHONPATH or the working directory)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(package.parent) in [str(Path(p).resolve()) for p in known if p]:
        return
    with tempfile.NamedTemporaryFile(suffix="_reelrank.zip", delete=False) as out:
        with zipfile.ZipFile(out, "w") as z:
            for f in package.rglob("*.py"):
                z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(out.name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder: one Parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir. Only a local
    master may fall back on a folder of this machine."""
    jsc = spark.sparkContext._jsc.sc()
    found = jsc.getCheckpointDir()
    if found.isDefined():
        return found.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="reelrank-checkpoint-")
    spark.sparkContext.setCheckpointDir(wanted)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared checkpoint folder and cut the lineage, so
    that several later passes read files instead of computing again and a lost
    executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clean_key(col: Column | str) -> Column:
    """A key without white space at its ends; null for null and blank keys."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.btrim(c, F.lit(WHITE_SPACE)), F.lit(""))


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def quoted(name: str) -> Column:
    """A column by its exact name, dots and dashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows up to which a small side, counted beforehand, is sent whole to every executor.
BROADCAST_ROWS = 300_000


def sized_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` narrow rows by a count made
    beforehand; else as it is, and the join shuffles (AQE splits skewed partitions)."""
    return F.broadcast(df) if rows <= limit else df
