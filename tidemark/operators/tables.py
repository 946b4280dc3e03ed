"""Rules of the stored tables, as operators on DataFrames and as writers of partitioned Parquet.

Reading is filtered by market and session, which are partition columns, so Spark prunes files. What a night
writes is staged under the name of its attempt and published by one small file; what a broken run leaves is
never seen and can be deleted at any later time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import schemas
from tidemark.sources import files, versions
from tidemark.sources.shared import stored


FEW = 64  #: sessions whose folders are looked up one by one


def keep_first(delivered: DataFrame, stored: DataFrame | None = None, order: str = "delivery") -> DataFrame:
    """What an append adds: the first delivery of each bar that isn't stored yet.

    order is the column that numbers deliveries; without it the copy of a bar with the least values is the first.
    """
    key = list(schemas.KEYS["bars"])
    if order in delivered.columns:
        w = Window.partitionBy(*key).orderBy(order)
        new = delivered.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", order)
    else:
        rest = [c for c in delivered.columns if c not in key]
        new = delivered.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_bar")).select(*key, "_bar.*").select(*delivered.columns)
    return new if stored is None else new.join(stored.select(*key), key, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: tuple[str, ...] = schemas.KEYS["labels"]) -> DataFrame:
    """The dimension after new rows take the place of stored ones with their key; a null in a new row keeps the stored value."""
    rest = [c for c in stored.columns if c not in key]
    a = stored.select(*key, *[F.col(c).alias(f"_old_{c}") for c in rest])
    b = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in rest])
    return a.join(b, list(key), "full_outer").select(*key, *[F.coalesce(f"_new_{c}", f"_old_{c}").alias(c) for c in rest])


def retained(ranks: DataFrame, months: int = 24) -> DataFrame:
    """Without the sessions that lie over so many months before their market's last one."""
    last = ranks.groupBy("market").agg(F.add_months(F.max("session"), -months).alias("_from"))
    return ranks.join(F.broadcast(last), "market").filter(F.col("session") >= F.col("_from")).drop("_from")


def readable(rows: DataFrame, runs: DataFrame, status: str | None = None) -> DataFrame:
    """Rows of sessions that have a run record (of that status): debris of a broken run is never seen."""
    known = runs if status is None else runs.filter(F.col("status") == status)
    return rows.join(known.select("market", "session").distinct(), ["market", "session"], "left_semi")


def debris(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """market, session of rows without a run record: what may be discarded."""
    return rows.select("market", "session").distinct().join(runs.select("market", "session"), ["market", "session"], "left_anti")


def path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def exists(spark: SparkSession, where: str) -> bool:
    return files.exists(spark, where)


def _partitions(table: str) -> list[str]:
    return ["market", "month"] if table == "bars" else ["market", "session", "attempt"]


def commits(spark: SparkSession, base: str) -> DataFrame:
    """market, session, table, attempt, rows: what the last commit that names a session's table says of it; a row a session and table.

    A commit is a file under commits, numbered within its market. It names the attempts whose rows are the
    sessions' tables, and how many they are; rows of any other attempt are never read.
    """
    where = path(base, "commits")
    kind = "market string, n int, session date, attempt string, tables map<string, bigint>"
    rows = spark.read.schema(kind).json(where) if exists(spark, where) else spark.createDataFrame([], kind)
    rows = rows.select("market", "session", "n", "attempt", F.explode("tables").alias("table", "rows"))
    last = rows.groupBy("market", "session", "table").agg(F.max_by(F.struct("attempt", "rows"), "n").alias("x"))
    return last.filter("x.attempt IS NOT NULL").select("market", "session", "table", "x.attempt", "x.rows")


def read(spark: SparkSession, base: str, table: str, *keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stored table with its declared columns; empty if nothing has been stored. keep: filters, which may name the partition columns.

    Of the tables that are stored by session only committed rows are seen; of labels, the last value of each column.
    """
    where, wanted = path(base, table), schemas.schema(table)
    if table == "labels":
        rows = versions.read(spark, where, wanted, schemas.KEYS[table])
    else:
        whole = wanted.add("month", "date") if table == "bars" else wanted.add("attempt", "string")
        rows = spark.read.schema(whole).parquet(where) if exists(spark, where) else spark.createDataFrame([], whole)
        schemas.check_stored(spark, where, wanted, table, _partitions(table))
    for f in keep:
        rows = f(rows)
    if table not in ("labels", "bars"):
        seen = commits(spark, base).filter(F.col("table") == table).select("market", "session", "attempt")
        rows = rows.join(F.broadcast(seen), ["market", "session", "attempt"], "left_semi")  # a row a session
    return rows.select(*schemas.schema(table).names)


def append_bars(spark: SparkSession, base: str, delivered: DataFrame) -> int:
    """Appends what isn't stored, and gives the number of bars that were new. Only the months of the batch are read."""
    return sum(x["n"] for x in append_counted(spark, base, delivered).groupBy().agg(F.sum("added").alias("n")).collect() if x["n"])


def append_counted(spark: SparkSession, base: str, delivered: DataFrame) -> DataFrame:
    """Appends what isn't stored, and gives market, symbol, delivered, added, for every symbol of the batch.

    delivered: bars; a column delivery, if there is one, numbers deliveries, and the first of a bar stays.
    Symbols whose new bars aren't later than their market's last published session are noted, so that the
    next night looks at their whole history.
    """
    delivered = delivered.withColumn("month", F.trunc("session", "month"))
    span = delivered.agg(F.min("month"), F.max("month")).first()
    if span[0] is None:
        return spark.createDataFrame([], "market string, symbol string, delivered bigint, added bigint")
    held = read(spark, base, "bars", lambda x: x.filter(F.col("month").between(*span)))
    new = stored(schemas.reconcile(keep_first(delivered, held), "bars"), "batch")
    last = read(spark, base, "runs").filter("status = 'published'").groupBy("market").agg(F.max("session").alias("_last"))
    late = new.join(F.broadcast(last), "market").filter(F.col("session") <= F.col("_last")).select("market", "symbol").distinct()
    if late.take(1):
        late.write.mode("append").partitionBy("market").parquet(path(base, "late"))  # before the bars: to be noted twice does no harm
    new.repartition(*_partitions("bars")).write.mode("append").partitionBy(*_partitions("bars")).parquet(path(base, "bars"))  # a file a month, not one of each task
    asked = delivered.groupBy("market", "symbol").agg(F.count("*").alias("delivered"))
    got = new.groupBy("market", "symbol").agg(F.count("*").alias("added"))
    return asked.join(got, ["market", "symbol"], "left").na.fill(0, ["added"])


def stage(spark: SparkSession, base: str, table: str, rows: DataFrame, attempt: str) -> None:
    """Writes rows of sessions as part of an attempt: nobody sees them until it is committed."""
    rows = schemas.reconcile(rows, table).withColumn("attempt", F.lit(attempt)).repartition("market", "session")  # a session has a row or a few a symbol
    rows.write.mode("append").partitionBy(*_partitions(table)).parquet(path(base, table))


def staged(spark: SparkSession, base: str, table: str, attempt: str, days: list[tuple[str, date]]) -> DataFrame:
    """What an attempt has staged for these (market, session); of few, only their folders are listed."""
    if len(days) > FEW:
        whole = schemas.schema(table).add("attempt", "string")
        rows = spark.read.schema(whole).parquet(path(base, table)) if exists(spark, path(base, table)) else spark.createDataFrame([], whole)
        return rows.filter(F.col("attempt") == attempt).select(*schemas.schema(table).names)
    folders = [f"{path(base, table)}/market={m}/session={d}/attempt={attempt}" for m, d in days]
    folders = [f for f in folders if exists(spark, f)]
    whole = schemas.schema(table).add("attempt", "string")
    rows = spark.read.schema(whole).option("basePath", path(base, table)).parquet(*folders) if folders else spark.createDataFrame([], whole)
    return rows.select(*schemas.schema(table).names)


def commit(spark: SparkSession, base: str, attempt: str | None, tables: tuple[str, ...], days: list[tuple[str, date]], seen: dict[str, int] | None = None) -> None:
    """Publishes what an attempt has staged for these (market, session): all sessions of a market at once, or none. attempt: None takes the tables' rows back.

    seen: the number of the last commit of each market that the attempt went by; raises if there has been
    another since, or if one of the tables is already written for one of the sessions.
    """
    seen = last_commits(spark, base) if seen is None else seen
    if attempt:
        names = spark.createDataFrame([(m, d) for m, d in days], "market string, session date")
        both = commits(spark, base).filter(F.col("table").isin(*tables)).join(F.broadcast(names), ["market", "session"], "left_semi").take(1)
        if both:
            raise ValueError(f"{both[0]['table']}: {both[0]['market']} {both[0]['session']} is already written")
    rows = {}
    if attempt:
        for t in tables:
            found = staged(spark, base, t, attempt, days).groupBy("market", "session").agg(F.count("*").alias("n")).collect()  # a row a session
            rows |= {(t, r["market"], r["session"]): r["n"] for r in found}
    for market in sorted({m for m, _ in days}):
        n = seen.get(market, 0) + 1
        lines = [{"n": n, "session": str(d), "attempt": attempt, "tables": {t: rows.get((t, m, d), 0) for t in tables}} for m, d in days if m == market]
        files.create(spark, f"{path(base, 'commits')}/market={market}/{n:08d}.json", "\n".join(map(json.dumps, lines)))


def last_commits(spark: SparkSession, base: str) -> dict[str, int]:
    """The number of each market's last commit."""
    where = path(base, "commits")
    names = [f.rsplit("/", 2) for f in files.listed(spark, f"{where}/market=*/*.json")]
    return {m.removeprefix("market="): max(int(n.removesuffix(".json")) for _, k, n in names if k == m) for _, m, _ in names}


def append_once(spark: SparkSession, base: str, table: str, rows: DataFrame) -> None:
    """Appends sessions; raises if any of them is stored already."""
    days = [(r["market"], r["session"]) for r in rows.select("market", "session").distinct().collect()]  # a row a session
    attempt = uuid.uuid4().hex
    stage(spark, base, table, rows, attempt)
    if days:
        commit(spark, base, attempt, (table,), days)


def discard_session(spark: SparkSession, base: str, table: str, market: str, session: str) -> int:
    """Takes a session's rows back, only if no run record stands; gives the number of rows that went."""
    here = (F.col("market") == market) & (F.col("session") == F.lit(session).cast("date"))
    if read(spark, base, "runs").filter(here).take(1):
        raise ValueError(f"{market} {session} has a run record")
    n = read(spark, base, table).filter(here).count()
    if n:
        commit(spark, base, None, (table,), [(market, date.fromisoformat(str(session)))])
    return n


def prune(spark: SparkSession, base: str, table: str, months: int) -> None:
    """Takes back and deletes the sessions that retained() leaves out."""
    days = commits(spark, base).filter(F.col("table") == table).select("market", "session")
    old = [(r["market"], r["session"]) for r in days.join(retained(days, months), ["market", "session"], "left_anti").collect()]  # sessions since the last pruning
    if old:
        commit(spark, base, None, (table,), old)
    for m, d in old:
        files.delete(spark, f"{path(base, table)}/market={m}/session={d}")


def vacuum(spark: SparkSession, base: str, table: str, hours: float = 48) -> int:
    """Deletes the folders of attempts that no commit names and that are older than any attempt still at work; gives their number."""
    known = {(r["market"], str(r["session"]), r["attempt"]) for r in commits(spark, base).filter(F.col("table") == table).collect()}  # a row a session
    gone = [f for f in files.listed(spark, f"{path(base, table)}/market=*/session=*/attempt=*", hours) if tuple(x.partition("=")[2] for x in f.split("/")[-3:]) not in known]
    for f in gone:
        files.delete(spark, f)
    return len(gone)
