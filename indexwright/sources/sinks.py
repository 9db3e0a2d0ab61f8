"""Dissemination layout, CSV and JSON extracts, and the guarded append."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexwright.schemas import INDEX, LEAD_TIME_BUCKETS, OBSERVATION

# Code lists of the dataset.
CODELISTS = {
    "FREQ": ["D", "W", "M"],
    "LEVEL": ["HEADLINE", "ROUTE", "STRATUM"],
    "LEAD_TIME": [code for code, _, _, _ in LEAD_TIME_BUCKETS],
}
DIMENSIONS = ["FREQ", "TIME_PERIOD", "LEVEL", "ROUTE", "LEAD_TIME"]
MEASURE = "OBS_VALUE"
ATTRIBUTES = [
    "METHODOLOGY_VERSION", "WEIGHT_SET_VERSION", "REVISION", "OBS_STATUS", "STD_ERROR", "PROVENANCE",
]
COLUMNS = [*DIMENSIONS, MEASURE, *ATTRIBUTES]

USAGE = "Compare movements, not levels, with other series. Values are text so that no digit is lost."


def dataset_schema() -> T.StructType:
    """The extract's columns with their role and code list as metadata."""
    fields = []
    for name in COLUMNS:
        role = "dimension" if name in DIMENSIONS else "measure" if name == MEASURE else "attribute"
        meta = {"role": role}
        if name in CODELISTS:
            meta["codes"] = CODELISTS[name]
        kind = INDEX if name in (MEASURE, "STD_ERROR") else T.IntegerType() if name == "REVISION" else T.StringType()
        fields.append(T.StructField(name, kind, True, meta))
    return T.StructType(fields)


def nonconforming(rows: DataFrame) -> DataFrame:
    """Dimension values outside their code list, with how many rows carry them.

    An empty ROUTE or LEAD_TIME is how the levels above leave a dimension out.
    """
    cells = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("code")) for d in CODELISTS
    ])
    seen = rows.select(F.explode(cells).alias("c")).select("c.*").groupBy("dimension", "code").agg(
        F.count("*").alias("rows")
    )
    codes = rows.sparkSession.createDataFrame(
        [(d, c) for d, codes in CODELISTS.items() for c in codes] + [("LEAD_TIME", "")],
        "dimension string, code string",
    )
    return seen.join(F.broadcast(codes), ["dimension", "code"], "left_anti")


def as_text(rows: DataFrame) -> DataFrame:
    """Extract columns as plain text: decimals and dates written out, NULL as empty."""
    have = set(rows.columns)
    return rows.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
        for c in COLUMNS
    ])


def write_csv(rows: DataFrame, path: str) -> None:
    """Bulk CSV; every row carries its methodology, weight set, revision and state."""
    as_text(rows).write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


@dataclass(frozen=True)
class Dataset:
    """What an extract says about itself."""

    id: str = "PRICE_INDEX"
    name: str = "Chained price index"
    agency: str = ""
    version: str = "1.0"
    description: str = "Index values by day, level, route and lead time"


def as_typed(rows: DataFrame) -> DataFrame:
    """Extract columns for JSON: whole numbers, flags and NULLs as they are, all else as text, so that no digit is lost."""
    kinds = dict(rows.dtypes)
    plain = ("tinyint", "smallint", "int", "bigint", "boolean", "string")
    return rows.select(*[
        (F.col(c) if kinds[c] in plain else F.col(c).cast("string")).alias(c) if c in kinds else F.lit(None).cast("string").alias(c)
        for c in COLUMNS
    ])


def write_json(rows: DataFrame, path: str, dataset: Dataset | None = None, extracted_at: Column | None = None) -> None:
    """A committed extract: JSON lines in ``data``, then a one-row ``envelope`` that counts what was written.

    The envelope is written last and only if all data are there, so an extract with
    an envelope (and Spark's success marker in it) is whole.
    """
    typed = as_typed(rows)
    typed.write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/data")
    stored = rows.sparkSession.read.schema(typed.schema).json(f"{path}/data")
    envelope(stored, dataset or Dataset(), extracted_at).write.mode("errorifexists").json(f"{path}/envelope")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a committed extract; fails where the envelope is missing or counts other rows."""
    said = spark.read.json(f"{path}/envelope").first()
    rows = spark.read.schema(", ".join(f"{c} {'int' if c == 'REVISION' else 'string'}" for c in COLUMNS)).json(f"{path}/data")
    if said is None or said["observations"] != rows.count():
        raise ValueError("the extract is not whole")
    return rows


def envelope(rows: DataFrame, dataset: Dataset, extracted_at: Column | None = None) -> DataFrame:
    at = F.current_timestamp() if extracted_at is None else extracted_at
    return rows.agg(F.count("*").alias("observations")).select(
        F.struct(*[F.lit(v).alias(k) for k, v in asdict(dataset).items()]).alias("dataset"),
        F.lit(dataset_schema().json()).alias("structure"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("extracted_at"),
        "observations",
        F.lit(USAGE).alias("usage"),
    )


IDENTITY = ["obs_date", "level", "route", "bucket", "methodology_version", "revision"]


def identity_conflicts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows whose identity is taken, by a stored row or by each other.

    Identities compare with NULLs equal, so two headlines of a day do conflict.
    """
    inside = (
        incoming.groupBy(*IDENTITY).agg(F.count("*").alias("copies")).filter("copies > 1").select(*IDENTITY)
        .withColumn("conflict", F.lit("REPEATED"))
    )
    stored = existing.select(*[F.col(c).alias(f"_{c}") for c in IDENTITY])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in IDENTITY]
    taken = incoming.join(stored, same, "left_semi").select(*IDENTITY).distinct().withColumn(
        "conflict", F.lit("EXISTS")
    )
    return inside.unionByName(taken)


class ObservationTable:
    """Observations under one folder, appended by any number of writers.

    A writer puts its rows into files of a run of its own, which nobody reads until
    the run is in the log: one small file for each commit, named by its number and
    holding the run's name. A number is taken by renaming a finished file to it, which
    fails if it is there; who finds it taken checks the runs committed meanwhile and
    tries the next. Runs that never commit stay unread.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._folder = self._hadoop.Path(f"{self.path}/log")
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def runs(self) -> dict[int, str]:
        """Committed runs by number; one row a commit, however many observations it has."""
        if not self._files.exists(self._folder):
            return {}
        rows = self.spark.read.text(f"{self.path}/log").select(F.col("_metadata.file_name").alias("number"), "value").collect()
        return {int(r["number"]): r["value"] for r in rows}

    def _take(self, number: int, run: str) -> bool:
        """Put a run into the log under a number; False if the number is taken."""
        entry = self._hadoop.Path(self._folder, f"_{run}")
        if not self._files.exists(entry):
            out = self._files.create(entry)
            out.write(bytearray(run.encode()))
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._folder.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(entry), context.makeQualified(self._hadoop.Path(self._folder, f"{number:012d}")), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception):
                raise
            return False
        return True

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        """Committed rows, of all runs or of those named."""
        named = list(self.runs().values()) if runs is None else runs
        if not named:
            return self.spark.createDataFrame([], OBSERVATION)
        folders = [f"{self.path}/runs/run={r}" for r in named]
        return self.spark.read.schema(OBSERVATION).option("basePath", f"{self.path}/runs").parquet(*folders).select(*OBSERVATION.names)

    def prepare(self, incoming: DataFrame) -> PreparedAppend:
        """Check the rows against what is committed and write them as a run that is not committed yet."""
        run = uuid.uuid4().hex
        have = set(incoming.columns)
        rows = incoming.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in OBSERVATION.fields])
        rows = rows.withColumn("index_value", F.bround("index_value", 6).cast(INDEX))
        rows.write.partitionBy("level", "obs_date").parquet(f"{self.path}/runs/run={run}")
        seen = self.runs()
        append = PreparedAppend(self, run, max(seen, default=0))
        append.check(list(seen.values()))
        return append

    def append(self, incoming: DataFrame) -> None:
        self.prepare(incoming).commit()


@dataclass
class PreparedAppend:
    """A run whose rows are written, and the last commit it was checked against."""

    table: ObservationTable
    run: str
    checked: int

    def check(self, runs: list[str]) -> None:
        """Fail if an identity is taken; only days that the run has are read of the others."""
        own = self.table.rows([self.run])
        days = [r["obs_date"] for r in own.select("obs_date").distinct().collect()]
        if not days:
            return
        theirs = self.table.rows(runs).filter(F.col("obs_date").isin(days)) if runs else self.table.rows([])
        if not identity_conflicts(own, theirs).isEmpty():
            raise ValueError("an observation with this identity is already stored")

    def commit(self) -> int:
        """Enter the run into the log, after a check against all that came before it."""
        while True:
            seen = self.table.runs()
            later = [r for n, r in sorted(seen.items()) if n > self.checked]
            if later:
                self.check(later)
            self.checked = max(seen, default=0)
            if self.table._take(self.checked + 1, self.run):
                return self.checked + 1


def append_observations(incoming: DataFrame, path: str) -> None:
    """Append to the observation table; fails the job when an identity is taken."""
    ObservationTable(incoming.sparkSession, path).append(incoming)
