"""Source catalogs (JSON or YAML), and builds that are staged, checked, made current and rolled back."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = "1.2"
# Names of the source types.
TYPES = {"git": "git", "git_repository": "git", "directory": "directory", "local": "directory", "local_directory": "directory", "web": "web", "official_web": "web"}


def load(path: str) -> list[dict]:
    """The sources of a catalog file: ids unique, types known, variables and ~ of paths expanded, relative paths from the catalog."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:  # optional dependency
            raise RuntimeError("YAML catalogs need PyYAML") from e
        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    out, seen = [], set()
    for entry in data["sources"]:
        if not entry.get("id") or entry["id"] in seen:
            raise ValueError(f"missing or repeated source id: {entry.get('id')!r}")
        if entry.get("type") not in TYPES:
            raise ValueError(f"unknown source type: {entry.get('type')!r}")
        seen.add(entry["id"])
        where = os.path.expanduser(os.path.expandvars(str(entry.get("path", ""))))
        if where and not os.path.isabs(where):
            where = os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), where))
        out.append(entry | {"type": TYPES[entry["type"]], "path": where})
    return out


_MANIFEST = "number long, build_id string, path string, state string, schema_version string, schemas map<string,string>, facts map<string,string>"


class Rejected(ValueError):
    """A staged build broke its checks; the build that was current still is."""


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The rows that publishing, rejecting and rolling back have appended, in order of ``number``; none if there is no build."""
    path = f"{root.rstrip('/')}/manifest"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(path)


def _append(spark: SparkSession, root: str, build_id: str, path: str, state: str, schemas: dict[str, str], facts: dict[str, str]) -> None:
    number = (manifest(spark, root).agg(F.max("number")).first()[0] or 0) + 1
    row = spark.createDataFrame([(number, build_id, path, state, SCHEMA_VERSION, schemas, facts)], _MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifest")


def publish(tables: dict[str, DataFrame], root: str, build_id: str, partitions: dict[str, tuple[str, ...]] | None = None, checks: Callable[[dict[str, DataFrame]], DataFrame] | None = None, facts: dict[str, str] | None = None) -> str:
    """Stage a build's tables, check them as they were written, then append the row that makes them the current build.

    Readers see all of a build or none of it. ``checks`` takes the staged tables and gives rows (check, detail) of
    what is wrong; any row rejects the build, which stays staged under a row of its own, and the build that was
    current stays current. One build is published at a time.
    """
    spark = next(iter(tables.values())).sparkSession
    where = f"{root.rstrip('/')}/{build_id}-{uuid.uuid4().hex[:8]}"
    schemas = {name: df.schema.json() for name, df in tables.items()}

    def write(name: str) -> None:
        tables[name].write.partitionBy(*(partitions or {}).get(name, ())).parquet(f"{where}/{name}")

    with ThreadPoolExecutor(len(tables)) as pool:  # small tables do not wait for large ones
        list(pool.map(write, tables))
    if checks is not None:
        wrong = checks(_read(spark, where, schemas)).orderBy("check").take(20)
        if wrong:
            said = "; ".join(f"{r['check']}: {r['detail']}" for r in wrong)
            _append(spark, root, build_id, where, "rejected", schemas, {"why": said})
            raise Rejected(said)
    _append(spark, root, build_id, where, "active", schemas, facts or {})
    return where


def _read(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a build with the schemas that they were written with; one without rows may have no file."""
    return {name: spark.read.schema(StructType.fromJson(json.loads(text))).parquet(f"{path}/{name}") for name, text in schemas.items()}


def _current_row(spark: SparkSession, root: str):
    row = manifest(spark, root).where("state = 'active'").orderBy(F.desc("number")).first()
    if row is None:
        raise FileNotFoundError(f"no build under {root}")
    if row.schema_version != SCHEMA_VERSION:
        raise ValueError(f"schema version {row.schema_version} is not {SCHEMA_VERSION}")
    return row


def opened(spark: SparkSession, root: str) -> tuple[dict[str, str], dict[str, DataFrame]]:
    """(what was recorded with the current build, its id included; its tables); another schema version is refused."""
    row = _current_row(spark, root)
    return dict(row.facts or {}) | {"build_id": row.build_id}, _read(spark, row.path, row.schemas)


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current build."""
    return opened(spark, root)[1]


def roll_back(spark: SparkSession, root: str) -> str:
    """Make the last active build before the current one current again, and say which; an error if there is none."""
    now = _current_row(spark, root)
    before = manifest(spark, root).where(F.col("state") == "active").where(F.col("path") != now.path).orderBy(F.desc("number")).first()
    if before is None:
        raise ValueError("there is no earlier build")
    _append(spark, root, before.build_id, before.path, "active", dict(before.schemas), dict(before.facts or {}))
    return before.build_id


def prune(spark: SparkSession, root: str, keep: int = 2, dry_run: bool = True) -> list[str]:
    """Paths of builds that are not among the ``keep`` paths made current last; deleted unless it is a dry run."""
    last = manifest(spark, root).groupBy("path").agg(F.max(F.when(F.col("state") == "active", F.col("number"))).alias("n"))
    rows = last.orderBy(F.desc_nulls_last("n"), "path").collect()  # a row a build
    kept = {r.path for r in [r for r in rows if r.n is not None][: max(keep, 1)]}
    gone = sorted(r.path for r in rows if r.path not in kept and r.path.startswith(root.rstrip("/") + "/"))
    if not dry_run:
        for path in gone:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return gone
