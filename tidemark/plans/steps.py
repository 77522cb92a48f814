"""The steps of a cycle over stored tables. Each is safe to repeat: it writes by key, or replaces its day."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import actions, ingest, news, patterns, signals, universe
from tidemark.operators import indicators as ind
from tidemark.operators.payload import check_answer
from tidemark.operators.screener import Rule, compile_rule, evaluate, load_window
from tidemark.plans.runner import StepError
from tidemark.schemas import CATALOG, KEY
from tidemark.sources.tables import TableStore, existing_ids, last_dates, normalize_prices

#: Names that a message spells out before it only counts the rest.
NAMED = 5


def run_indicators(store: TableStore, members: DataFrame, as_of: date, *, sessions: int = 250, forced: DataFrame | None = None) -> dict[str, int]:
    """Works the whole catalog out over the last sessions and stores the rows that are new, or all of forced keys.

    It fails if no candle of the day was promoted. Counts: expected keys, keys with the day's bar, rows written.
    """
    keys = universe.universe_keys(members)
    bars = store.scan("prices", start=universe.lookback_start(as_of, sessions), end=as_of, keys=keys, order=False)
    today = bars.where(F.col("date") == F.lit(as_of)).select(*KEY).distinct().count()
    if not today:
        raise StepError(f"no candle of {as_of} was promoted")
    base = bars.select(*KEY, "date", "high", "low", "close", "adj_close", "volume")
    computed = ind.indicators(base).join(patterns.pattern_columns(bars), [*KEY, "date"], "left").drop("high", "low")
    rows = ind.select_rows(computed, last_dates(store.read("indicators"), keys), forced).withColumn("computed_at", F.current_timestamp()).persist()
    try:
        store.upsert("indicators", rows)
        return {"expected": keys.count(), "with_today": today, "rows": rows.count()}
    finally:
        rows.unpersist()


def reconcile_corporate_actions(staging: TableStore, prod: TableStore, members: DataFrame, quarantine: DataFrame, as_of: date, *, provider: Callable[[DataFrame, date], DataFrame], sessions: int = 250) -> dict[str, DataFrame]:
    """Events that aren't recorded yet; keys whose history they make stale are fetched anew, and quarantined jumps that a
    split of the day explains are released. What is free goes to production, and the events are recorded last, so that a
    run that fails halfway finds them again.

    quarantine: ticker, mic, reason. Gives the new events and the keys that were re-read and released.
    """
    keys, start = universe.universe_keys(members), universe.lookback_start(as_of, sessions)
    window = staging.scan("prices", start=start, end=as_of, keys=keys, order=False).persist()
    try:
        detected = actions.from_feed(window).unionByName(actions.by_ratio(window, as_of))
        new = actions.new_events(detected, prod.read("corporate_actions")).persist()
        stale = actions.needs_reingest(window, new).persist()
        free = actions.released(quarantine, detected, as_of).select(*KEY).persist()
        still = quarantine.select(*KEY).join(free, KEY, "left_anti")
        if stale.limit(1).count():
            again = stale.withColumn("start", F.lit(start))
            staging.upsert("prices", normalize_prices(provider(again, as_of)).withColumn("ingested_at", F.current_timestamp()))
        refreshed = staging.scan("prices", start=start, end=as_of, keys=keys, order=False)
        promoted = actions.rows_to_promote(refreshed, stale, free, as_of, still)
        if promoted.limit(1).count():
            prod.upsert("prices", promoted)
        prod.upsert("corporate_actions", new.withColumn("detected_at", F.current_timestamp()))
        return {"events": new, "reingested": stale, "released": free}
    finally:
        window.unpersist()


def store_snapshot(store: TableStore, members: DataFrame, as_of: date, *, region: str, min_coverage: float = 0.95) -> tuple[str, bool]:
    """Freezes the day's panel and its header: (hash, whether it differs from what was stored before).

    The day is replaced whole. It fails without a row, or with too few of the members.
    """
    own = universe.universe_members(members)
    today = store.scan("indicators", start=as_of, end=as_of, keys=own, order=False)
    try:
        panel, digest, share = signals.run_snapshot(own, today.select(*KEY, "date", "close", "adj_close", "volume", *CATALOG), min_coverage=min_coverage)
    except ValueError as e:
        raise StepError(str(e)) from e
    before = store.snapshot_header(region, as_of)
    store.replace_day("snapshots", panel.withColumn("region", F.lit(region)).withColumn("created_at", F.current_timestamp()), region=region, date=as_of)
    head = [(region, as_of, digest, panel.count(), own.count(), share)]
    store.replace_day("snapshot_runs", store.spark.createDataFrame(head, "region string, date date, snapshot_hash string, rows int, expected int, coverage double").withColumn("created_at", F.current_timestamp()), region=region, date=as_of)
    return digest, before is None or before.snapshot_hash != digest


def news_targets(candidates: DataFrame, positions: DataFrame | None = None, panel: DataFrame | None = None) -> DataFrame:
    """Keys to ask news for: candidates and open positions, or with a panel all of its keys."""
    if panel is not None:
        return panel.select(*KEY).distinct()
    own = candidates.select(*KEY)
    return (own if positions is None else own.unionByName(positions.select(*KEY))).distinct()


@dataclass
class NewsReport:
    fetched: int
    new: int
    failed: dict[str, str] = field(default_factory=dict)


def collect_news(store: TableStore, targets: DataFrame, sources: dict[str, Callable], attributes: DataFrame, as_of: date, *, since, until) -> NewsReport:
    """Articles of all sources, stored by id. A source may fail; if all do, the step does.

    sources: name -> callable(tickers as rows of `ticker`, since) -> articles; attributes: source, reliability, language.
    """
    if not sources:
        raise StepError("there are no news sources")
    tickers = targets.groupBy("ticker").agg(F.min("mic").alias("mic"))
    found, failed = None, {}
    for name, fetch in sources.items():
        try:
            own = fetch(tickers.select("ticker"), since).select(F.lit(name).alias("source"), "ticker", "published_at", "title", "summary", "url").persist()
            own.count()
        except (OSError, ValueError) as e:
            failed[name] = str(e)
            continue
        found = own if found is None else found.unionByName(own)
    if found is None:
        raise StepError("no news source answered: " + "; ".join(f"{k}: {v}" for k, v in failed.items()))
    frame = news.news_frame(found, attributes, tickers, since=since, until=until).withColumn("as_of", F.lit(as_of)).withColumn("fetched_at", F.current_timestamp()).persist()
    try:
        n = frame.count()
        known = existing_ids(store.read("news"), frame.select("id")).count()
        store.upsert("news", frame)
        return NewsReport(n, n - known, failed)
    finally:
        frame.unpersist()


def store_topics(store: TableStore, articles: DataFrame, as_of: date, *, region: str, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), score: Callable | None = None, **cascade) -> DataFrame:
    """Clusters the day's articles; topics, with the sentiment of their representatives, and members replace the day's."""
    clustered = news.cluster_articles(articles, **cascade).persist()
    try:
        topics = news.add_sentiment(news.topics(clustered, weights), score).withColumns({"region": F.lit(region), "as_of": F.lit(as_of), "created_at": F.current_timestamp()})
        own = news.topics(clustered, weights).select("cluster_id", F.col("representative_id").alias("_r"))
        component = clustered.select(F.col("id").alias("_r"), "component").join(own, "_r").select("component", "cluster_id", "_r")
        members = clustered.join(component, "component").select("cluster_id", F.col("id").cast("string").alias("news_id"), "method", (F.col("id") == F.col("_r")).alias("is_representative"), F.lit(region).alias("region"), F.lit(as_of).alias("as_of"), F.current_timestamp().alias("created_at"))
        store.replace_day("news_clusters", topics, region=region, as_of=as_of)
        store.replace_day("news_cluster_members", members, region=region, as_of=as_of)
    finally:
        clustered.unpersist()
    return store.day("news_clusters", region=region, as_of=as_of)


def persist_signals(store: TableStore, candidates: DataFrame, panel: DataFrame, sessions: DataFrame, as_of: date, *, region: str, snapshot_hash: str, verdicts: DataFrame | None = None, model: str | None = None) -> tuple[int, int]:
    """The day's signals replace those stored for region and day: (saved, replaced)."""
    replaced = store.day("signals", region=region, date=as_of).count()
    try:
        built = signals.build_signals(candidates, panel, sessions, as_of, region=region, snapshot_hash=snapshot_hash, verdicts=verdicts, model=model)
    except ValueError as e:
        raise StepError(str(e)) from e
    store.replace_day("signals", built.withColumn("created_at", F.current_timestamp()), region=region, date=as_of)
    return store.day("signals", region=region, date=as_of).count(), replaced


@dataclass(frozen=True)
class Reply:
    """A model's answer and the tokens that it took."""

    text: str
    input_tokens: int = 0
    output_tokens: int = 0
    cache_write_tokens: int = 0
    cache_read_tokens: int = 0
    batch: bool = False


@dataclass(frozen=True)
class ModelReport:
    answer: dict
    cost_eur: float
    month_eur: float
    reused: bool
    over_budget: bool


def ask_model(store: TableStore, payload: str, tickers: set[str], as_of: date, *, region: str, model: str, ask: Callable[[str], Reply], monthly_budget: float = 5.0, **prices: float) -> ModelReport:
    """The checked answer to a payload. A recorded one for the same payload and model is used again at no cost, if it can
    still be read; else the model is asked and the call recorded with its cost. The budget only warns."""
    digest = hashlib.sha256(payload.encode()).hexdigest()
    saved, answer = store.llm_call(region, as_of, model=model, payload_hash=digest), None
    if saved is not None:
        try:
            answer = check_answer(saved.response, tickers)
        except (ValueError, KeyError, TypeError):
            answer = None
    cost, reused = 0.0, answer is not None
    if answer is None:
        reply = ask(payload)
        try:
            answer = check_answer(reply.text, tickers)
        except (ValueError, KeyError, TypeError) as e:
            raise StepError(f"the model's answer can't be used: {e}") from e
        call = store.spark.createDataFrame([(region, as_of, model, digest, reply.batch, reply.input_tokens, reply.output_tokens, reply.cache_write_tokens, reply.cache_read_tokens, reply.text)], "region string, date date, model string, payload_hash string, batch boolean, input_tokens int, output_tokens int, cache_write_tokens int, cache_read_tokens int, response string")
        call = call.withColumn("cost_eur", signals.estimate_cost(**prices))
        cost = call.first().cost_eur
        store.upsert("llm_calls", call.withColumn("created_at", F.current_timestamp()))
    month = signals.month_cost(store.read("llm_calls"), as_of).first().cost_eur
    return ModelReport(answer, cost, month, reused, month > monthly_budget)


def run_reconcile(store: TableStore, as_of: date, *, region: str, max_open_gap: float = 0.02) -> DataFrame | None:
    """Reconciles what is pending with the opens of production; None if nothing is.

    It fails closed: without any candle, without one of the day while signals execute today, or if the store has not as
    many of the signals as were reconciled.
    """
    due = signals.pending(store.read("signals").where(F.col("region") == F.lit(region)), as_of).persist()
    try:
        span = due.agg(F.min("execute_on").alias("first"), F.max("execute_on").alias("last")).first()
        if span.first is None:
            return None
        candles = store.scan("prices", start=span.first, end=as_of, keys=due, order=False).select(*KEY, "date", "open")
        latest = candles.agg(F.max("date").alias("d")).first().d
        if latest is None or (span.last == as_of and latest != as_of):
            raise StepError(f"production has no prices of {as_of}; that session's cycle must run first")
        done = signals.reconcile(due, candles, max_open_gap=max_open_gap).withColumn("reconciled_at", F.current_timestamp()).persist()
        n = done.count()
        updated = store.update("signals", done, ["execution_open", "open_gap", "reconcile_status", "reconciled_at"])
        if updated != n:
            raise StepError(f"{n} signals were reconciled but {updated} were updated")
        return done
    finally:
        due.unpersist()


def named_gaps(done: DataFrame, most: int = NAMED) -> DataFrame:
    """rank, ticker, open_gap of deviated signals, the widest first, a ticker once; at most `most`."""
    one = done.where("reconcile_status = 'desviada'").groupBy("ticker").agg(F.max_by("open_gap", F.abs("open_gap")).alias("open_gap"))
    return one.orderBy(F.abs("open_gap").desc(), "ticker").limit(most)


def rule_counts(panel: DataFrame, as_of: date, *, rules: list[Rule], indicators: DataFrame, min_score: float = 0.0, min_avg_volume: float = 0.0) -> DataFrame:
    """rule_id, eligible, candidates, and how many keys of the panel were left out as illiquid (null volume too)."""
    compiled = [compile_rule(r) for r in rules]
    enough = F.coalesce(F.col("avg_volume_20") >= min_avg_volume, F.lit(False))
    judged = evaluate(load_window(indicators, panel.where(enough), as_of, max(r.sessions for r in compiled)), compiled)
    chosen = F.col("eligible") & (F.col("score") >= F.greatest("threshold", F.lit(min_score)))
    return judged.groupBy("rule_id").agg(F.count_if("eligible").alias("eligible"), F.count_if(chosen).alias("candidates")).crossJoin(panel.agg(F.count_if(~enough).alias("illiquid")))


@dataclass(frozen=True)
class UniverseSpec:
    """Where a universe's listing comes from, what completes it, and whether the source knows the history itself."""

    id: str
    source: Callable[[], DataFrame]
    enrichers: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    history: bool = False
    mic: str | None = None
    currency: str | None = None


def union_of_snapshots(parts: dict[str, DataFrame]) -> DataFrame:
    """Listings of several pages as one: a key once, of the page that comes first by name, with open intervals."""
    out = None
    for name in sorted(parts):
        own = parts[name].withColumn("source", F.lit(name)).withColumn("start", F.lit(None).cast("date")).withColumn("end", F.lit(None).cast("date"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    first = out.groupBy("ticker", F.coalesce("mic", F.lit("")).alias("_m")).agg(F.min(F.struct("source", *[c for c in out.columns if c not in ("source", "ticker")])).alias("x"))
    return first.select("ticker", *[F.col(f"x.{c}").alias(c) for c in out.columns if c != "ticker"]).select(*out.columns)


def build_universe(spec: UniverseSpec, previous: DataFrame | None, today: date) -> DataFrame:
    """Source, enrichers, roll of the intervals (unless the source has them), then the constituents' columns."""
    table = spec.source()
    missing = [c for c in ("ticker",) if c not in table.columns]
    if missing:
        raise StepError(f"{spec.id}: missing columns {', '.join(missing)}")
    for c, kind in (("mic", "string"), ("start", "date"), ("end", "date")):
        table = table if c in table.columns else table.withColumn(c, F.lit(None).cast(kind))
    for enrich in spec.enrichers:
        table = enrich(table)
    if not spec.history:
        empty = table.limit(0)
        table = universe.roll_snapshot(empty if previous is None else previous, table, today)
    return universe.finalize(table, mic=spec.mic, currency=spec.currency, source=spec.id)


def write_constituents(table: DataFrame, path: str, meta: dict) -> None:
    """The table as Parquet at path, and beside it what it is made of, as one line of JSON."""
    table.write.mode("overwrite").parquet(path)
    row = json.dumps({**meta, "rows": table.count(), "current_members": table.where("end is null").count()}, sort_keys=True, default=str)
    table.sparkSession.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def backfill(store: TableStore, constituents: DataFrame, as_of: date, years: int, *, provider: Callable, fallback: Callable | None = None) -> ingest.IngestReport:
    """Candles of all that were members in the last years, also of those that have left, over what is stored."""
    start = as_of - timedelta(days=365 * years)
    return ingest.ingest_prices(universe.members_between(constituents, start, as_of).select(*KEY), as_of, provider=provider, store=store, default_start=start, force_start=start, fallback=fallback)


def member_pattern_stats(prod: TableStore, staging: TableStore, constituents: DataFrame, as_of: date, *, horizon: int | None = None, years: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(by pattern, by pattern and year): what came of the figures of today's members in production, or with `years` of
    all who were members then, in staging."""
    start = None if years is None else as_of - timedelta(days=365 * years)
    own = universe.members_as_of(constituents, as_of) if years is None else universe.members_between(constituents, start, as_of)
    bars = (prod if years is None else staging).scan("prices", start=start, end=as_of, keys=universe.universe_keys(own), order=False)
    if not bars.limit(1).count():
        raise StepError(f"there are no candles up to {as_of}")
    matches = patterns.find_patterns(bars)
    done = patterns.follow(matches, bars) if horizon is None else patterns.follow(matches, bars, horizon)
    return patterns.pattern_stats(done), patterns.pattern_stats_yearly(done)


def digest_rows(rows: DataFrame, analysed: bool) -> DataFrame:
    """A digest's signals: each key once, by confidence and score (by score without verdicts), the surest first."""
    by = ["confidence", "score"] if analysed else ["score"]
    best = F.struct(*[(-F.coalesce(c, F.lit(0.0))).alias(c) for c in by], F.col("rule_id"))
    one = rows.groupBy(*KEY).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in KEY]), best).alias("x"))
    return one.select(*KEY, "x.*").orderBy(*[F.desc(c) for c in by], "ticker", "mic")


def digest_counts(rows: DataFrame) -> DataFrame:
    """label, n: confirmed keys by direction, then those that are watched and discarded, each key once."""
    one = digest_rows(rows, True)
    label = F.when(F.col("verdict") == "confirmar", F.col("direction")).otherwise(F.col("verdict"))
    return one.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
