"""A whole run: discover links, extract articles, write them, remember the URLs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..operators.articles import articles, extract_groups, fetch_join, unique_ids
from ..operators.links import discover
from ..operators.seen import DEFAULT_TTL, mark_seen
from ..sources.lineage import written
from ..sources.seen_store import SeenStore
from ..sources.sinks import NOTIFIERS, Stored, fan_out, new_run_id
from .spec import Spec


def scrape(
    spec: Spec,
    pages: DataFrame,
    seen: DataFrame | None = None,
    limit: int | None = None,
    as_of: datetime | None = None,
    strict: bool = True,
    start: DataFrame | None = None,
) -> DataFrame:
    """The articles of a spec.

    The links are found first and written down: they are small next to the
    pages, and knowing them, only the HTML they ask for is moved.
    """
    now = as_of or datetime.now()
    links = discover(pages, spec, seen, limit, now, strict, start)
    found = extract_groups(fetch_join(links, pages), spec, now)
    return articles(found, spec, now)


def merged(specs: list[Spec]) -> Spec:
    """Several specs as one: their groups, one after the other.

    So pages are scanned once for links and once for articles, however many specs there are.
    """
    return Spec(tuple(g for s in specs for g in s.groups))


def run_all(
    specs: list[Spec],
    pages: DataFrame,
    seen: DataFrame | None = None,
    limit: int | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The articles of several specs, one per id."""
    return unique_ids(written(scrape(merged(specs), pages, seen, limit, as_of)))


@dataclass
class Result:
    """What a run left behind: its articles, the seen table after it, an error or None per sink, the ids stored."""

    articles: DataFrame
    seen: DataFrame
    outcome: dict[str, Exception | None]
    stored: DataFrame
    run_id: str


def deliver(
    found: DataFrame,
    run_id: str,
    sinks: list[tuple[str, dict]],
    notify: tuple[str, dict],
    seen_store: SeenStore | None,
    ttl: timedelta,
    now: datetime,
) -> Stored:
    """Written articles to every sink, the notice of what was stored, the seen entries."""
    stored = fan_out(found, sinks, run_id, stored=True)
    name, options = notify
    NOTIFIERS[name](stored.ids, run_id=run_id, **options)
    if seen_store is not None:
        seen_store.add(mark_seen(None, found.select("url"), ttl, now), run_id, now)
    return stored


def run(
    spark: SparkSession,
    spec: Spec | list[Spec],
    pages: DataFrame,
    seen: DataFrame | None = None,
    limit: int | None = None,
    ttl: timedelta = DEFAULT_TTL,
    as_of: datetime | None = None,
    sinks: list[tuple[str, dict]] | None = None,
    notify: tuple[str, dict] = ("noop", {}),
    seen_store: SeenStore | None = None,
    run_id: str | None = None,
    strict: bool = True,
) -> Result:
    """Run a spec, or several in one pass, write to every sink, send one completion notice.

    Without ``run_id`` the run gets a new one and adds to what is there; a run
    that is repeated under its id replaces what it had written.  Of several specs
    an article is kept once per id.  The notice lists what at least one sink stored.

    What counts as seen comes from ``seen``, or from ``seen_store``, which then
    also gets the new entries.  They cover every article, also one that a sink
    failed to store.
    """
    now = as_of or datetime.now()
    run_id = run_id or new_run_id()
    if seen_store is not None:
        seen = seen_store.read(spark, run_id)
    # written once: sinks, notice and seen table all read it
    one = spec if isinstance(spec, Spec) else merged(spec)
    found = written(scrape(one, pages, seen, limit, now, strict))
    if one is not spec:
        found = written(unique_ids(found))
    stored = deliver(found, run_id, sinks or [("noop", {})], notify, seen_store, ttl, now)
    return Result(found, mark_seen(seen, found.select("url"), ttl, now), stored.outcome, stored.ids, run_id)
