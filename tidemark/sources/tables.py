"""Tables in Parquet: scans, upserts, replaced days, updates by key."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.schemas import KEY, TABLES, check_identifier, conform, require_columns


#: Day column by which a table's files are kept apart, month by month; other tables are one part.
MONTHS = {t: next((c for c in ("date", "as_of", "day") if c in pk), None) for t, (_, pk) in TABLES.items()}
#: Stamps that tell which of two rows of one key was written later.
STAMPS = ["ingested_at", "fetched_at", "computed_at", "detected_at", "updated_at", "created_at"]
#: States of a table that are kept, so that plans made on an older one can still be run.
STATES = 3


class ConcurrentWrite(RuntimeError):
    """Another writer has stored a state of the table since this one read it; nothing was written."""


class TableStore:
    """Tables under root/schema/table, in parts by month of their day, and a small file that lists the parts of a state.

    A write makes new folders for the parts that it touches and then names the new state, in one rename. Readers see the
    old or the new state, never part of one; the last states stay readable. A writer claims the number after the state
    that it has read, which one writer can; a second one fails with ConcurrentWrite and may try again. Plain Parquet has
    no transactions across tables. A writer that dies between claim and state leaves the claim to release().
    """

    def __init__(self, spark: SparkSession, root: str, schema: str = "prod"):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), check_identifier(schema)
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, self.schema, *parts]))

    def _states(self, table: str) -> list[str]:
        base = self._path(table)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(base) if x.getPath().getName().startswith("_state-")) if self._fs.exists(base) else []

    def _listed(self, table: str, state: str) -> dict[str, str]:
        stream = self._fs.open(self._path(table, state))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _parts(self, table: str) -> dict[str, str]:
        """Folder of each part in the present state."""
        states = self._states(table)
        return self._listed(table, states[-1]) if states else {}

    def _base(self, table: str) -> tuple[int, dict[str, str]]:
        """The number of the present state, -1 if there is none, and the folder of each of its parts, read together."""
        states = self._states(table)
        return (int(states[-1].split("-")[1]), self._listed(table, states[-1])) if states else (-1, {})

    def _read(self, table: str, parts: dict[str, str]) -> DataFrame:
        schema = TABLES[table][0]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(table, x).toString() for x in sorted(parts.values())])

    def read(self, table: str) -> DataFrame:
        """The whole table with its declared columns; older files lack new columns, which read as null."""
        return self._read(table, self._parts(table))

    def _part(self, table: str) -> Column:
        day = MONTHS[table]
        return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("none")) if day else F.lit("all")

    def _touched(self, table: str, df: DataFrame) -> set[str]:
        return {r.p for r in df.select(self._part(table).alias("p")).distinct().collect()}  # as many as there are months

    def _store(self, table: str, df: DataFrame, parts: set[str], base: tuple[int, dict[str, str]]) -> None:
        """Makes df the whole content of these parts; the others stay as they are in `base`, the state that df was made of."""
        new, (last, now) = uuid.uuid4().hex, base
        df.withColumn("part", self._part(table)).write.partitionBy("part").parquet(self._path(table, new).toString())
        made = {x.getPath().getName()[5:]: f"{new}/{x.getPath().getName()}" for x in self._fs.listStatus(self._path(table, new)) if x.getPath().getName().startswith("part=")}
        state = {k: v for k, v in now.items() if k not in parts} | made
        out = self._fs.create(self._path(table, f"_tmp-{new}"))
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        target = self._path(table, f"_state-{last + 1:012d}")
        # creating a file that must not exist yet is the one step that only one writer can take
        if self._fs.exists(target) or not self._fs.createNewFile(self._path(table, f"_claim-{last + 1:012d}")):
            self._fs.delete(self._path(table, f"_tmp-{new}"), False)
            self._fs.delete(self._path(table, new), True)
            raise ConcurrentWrite(f"{table}: state {last + 1} has another writer")
        if not self._fs.rename(self._path(table, f"_tmp-{new}"), target):
            raise RuntimeError(f"{table}: state {last + 1} could not be named")
        self._clear(table)

    def release(self, table: str) -> None:
        """Takes back claims whose writer never stored a state. Only when no writer of the table is running."""
        named = {x.split("-")[1] for x in self._states(table)}
        base = self._path(table)
        for x in self._fs.listStatus(base) if self._fs.exists(base) else []:
            name = x.getPath().getName()
            if name.startswith("_claim-") and name.split("-")[1] not in named:
                self._fs.delete(x.getPath(), False)

    def _clear(self, table: str) -> None:
        """Deletes states that are too old, with their claims, and folders that no kept state lists."""
        states = self._states(table)
        for x in states[:-STATES]:
            self._fs.delete(self._path(table, x), False)
            self._fs.delete(self._path(table, x.replace("_state-", "_claim-")), False)
        used = {v.split("/")[0] for x in states[-STATES:] for v in self._listed(table, x).values()}
        for x in self._fs.listStatus(self._path(table)):
            if not x.getPath().getName().startswith("_") and x.getPath().getName() not in used:
                self._fs.delete(x.getPath(), True)

    def upsert(self, table: str, df: DataFrame, order: list[str] | None = None) -> None:
        """Rows of df replace those of equal primary key. Of duplicates in df the last in `order` stays, by default the
        last by its stamp, and among those the greatest by its other columns. Only the parts of df's months are rewritten."""
        pk = TABLES[table][1]
        require_columns(df, pk)
        by = order or [c for c in STAMPS if c in df.columns]
        source = conform(df, table).persist()
        try:
            base, touched = self._base(table), self._touched(table, source)
            old = {k: v for k, v in base[1].items() if k in touched}
            self._store(table, merge(self._read(table, old), source, pk, by), touched, base)
        finally:
            source.unpersist()

    def replace_day(self, table: str, df: DataFrame, **partition) -> None:
        """All rows of the partition (column=value) go and df's rows come, also if df is empty."""
        same = F.lit(True)
        for c, v in partition.items():
            same = same & F.col(check_identifier(c)).eqNullSafe(F.lit(v))
        base = self._base(table)
        source, now = conform(df, table), base[1]
        day = partition.get(MONTHS[table])
        touched = ({f"{day:%Y-%m}"} if day else set(now)) | self._touched(table, source)
        self._store(table, self._read(table, {k: v for k, v in now.items() if k in touched}).where(~same).unionByName(source), touched, base)

    def update(self, table: str, df: DataFrame, columns: list[str]) -> int:
        """Columns of the rows that df names by primary key; keys that aren't there are left out. How many there are."""
        pk = TABLES[table][1]
        base, touched = self._base(table), self._touched(table, df)
        target = self._read(table, {k: v for k, v in base[1].items() if k in touched})
        n = target.join(df.select(*pk).distinct(), pk, "left_semi").count()
        self._store(table, update_by_key(target, df, pk, columns), touched, base)
        return n

    def scan(self, table: str, columns: list[str] | None = None, *, start: date | None = None, end: date | None = None, keys: DataFrame | None = None, order: bool = True) -> DataFrame:
        """scan() over the parts whose months the range touches."""
        months = {k: v for k, v in self._parts(table).items() if MONTHS[table] != "date" or k == "none" or (start is None or k >= f"{start:%Y-%m}") and (end is None or k <= f"{end:%Y-%m}")}
        return scan(self._read(table, months), columns, start=start, end=end, keys=keys, order=order)

    def news(self, since, keys: DataFrame | None = None, *, include_global: bool = True) -> DataFrame:
        return news_since(self.read("news"), since, keys, include_global=include_global)

    def day(self, table: str, **partition) -> DataFrame:
        """The rows of a partition (column=value): a snapshot of a region's day, its topics or their members."""
        out, day = self._parts(table), partition.get(MONTHS[table])
        found = self._read(table, {k: v for k, v in out.items() if day is None or k == f"{day:%Y-%m}"})
        for c, v in partition.items():
            found = found.where(F.col(check_identifier(c)) == F.lit(v))
        return found

    def snapshot_header(self, region: str, day: date) -> Row | None:
        return self.day("snapshot_runs", region=region, date=day).limit(1).first()

    def llm_call(self, region: str, day: date, *, model: str, payload_hash: str) -> Row | None:
        """The recorded call for exactly this payload and model."""
        return self.day("llm_calls", region=region, date=day).where((F.col("model") == model) & (F.col("payload_hash") == payload_hash)).limit(1).first()

    def signals(self, day: date, region: str | None = None) -> DataFrame:
        """A day's signals, best first."""
        own = self.day("signals", date=day) if region is None else self.day("signals", date=day, region=region)
        return own.orderBy(F.desc("score"), "ticker", "mic", "rule_id")

    def calls(self, provider: str, day: date) -> int:
        row = self.day("api_calls", provider=provider, day=day).first()
        return row.calls if row else 0

    def reserve_calls(self, provider: str, day: date, calls: int, limit: int) -> bool:
        """Counts calls to a provider; a reservation that would pass the limit is refused and counts nothing."""
        used = self.calls(provider, day)
        if used + calls > limit:
            return False
        self.upsert("api_calls", self.spark.createDataFrame([(provider, day, used + calls)], "provider string, day date, calls int").withColumn("updated_at", F.current_timestamp()))
        return True


def scan(df: DataFrame, columns: list[str] | None = None, *, start: date | None = None, end: date | None = None, keys: DataFrame | None = None, order: bool = True) -> DataFrame:
    """Projection, inclusive date range and key filter; the range and the columns reach the Parquet scan."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    if keys is not None:
        df = df.join(keys.select(*KEY).distinct(), KEY, "left_semi")
    if columns is not None:
        df = df.select(*columns)
    by = [c for c in (*KEY, "date") if c in df.columns]
    return df.orderBy(*by) if order and by else df


def news_since(news: DataFrame, since, keys: DataFrame | None = None, *, include_global: bool = True) -> DataFrame:
    """Articles published from `since` on, of the keys' tickers or, if asked for, of no ticker; newest first."""
    recent = news.where(F.col("published_at") >= F.lit(since))
    if keys is not None:
        own = recent.where(F.col("ticker").isNotNull()).join(keys.select("ticker").distinct(), "ticker", "left_semi").select(*news.columns)
        recent = own.unionByName(recent.where(F.col("ticker").isNull())) if include_global else own
    elif not include_global:
        recent = recent.where(F.col("ticker").isNotNull())
    return recent.orderBy(F.desc("published_at"), "id")


def existing_ids(news: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the ids that the store holds, each once."""
    return ids.select("id").distinct().join(news.select("id"), "id", "left_semi")


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the last in the given order, then the greatest by its other columns, so that no row's place decides."""
    named = {*keys, *(o for o in order if isinstance(o, str))}
    order = (*order, *(c for c in df.columns if c not in named))
    w = Window.partitionBy(*keys).orderBy(*[o.desc() if isinstance(o, Column) else F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(target: DataFrame, source: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Target rows whose key source lacks, and one source row per key: the last in `order`, see keep_last."""
    last = keep_last(source, keys, *(order or []))
    return target.join(last.select(*keys), keys, "left_anti").select(*target.columns).unionByName(last)


def update_by_key(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Target with the columns of matching source rows."""
    own = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = target.join(own, keys, "left")
    return out.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def normalize_prices(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Candles as they are stored: no null close, unknown markets named, dates without time, whole volumes, and of
    duplicates the last in `order` (by default the last read, where rows say when), see keep_last."""
    order = order or [c for c in STAMPS if c in df.columns]
    require_columns(df, ["ticker", "mic", "date", "open", "high", "low", "close", "adj_close", "volume"])
    out = df.withColumn("mic", F.coalesce("mic", F.lit("UNKNOWN"))).withColumn("date", F.to_date("date"))
    out = out.withColumn("volume", F.bround(F.col("volume").cast("double")).cast("long")).withColumn("close", F.nanvl(F.col("close").cast("double"), F.lit(None).cast("double"))).where("close is not null")
    return keep_last(out, [*KEY, "date"], *order)


def last_dates(df: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    df = df if keys is None else df.join(keys.select(*KEY).distinct(), KEY, "left_semi")
    return df.groupBy(*KEY).agg(F.max("date").alias("last_date"))


def stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*KEY)).alias("n_keys"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
