"""Operators over streams of changes: history of files, people, time and areas.

changes: (commit, author, ts, path, added, deleted), one row a changed path. commits: (commit, author, ts).
Windows of time end at the latest commit, not at the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import activity_areas, activity_level, area_of, days_until, parse_version, round4
from siltstone.functions.tables import part_count

DAY = 86_400


def latest(commits: DataFrame) -> DataFrame:
    """One row (latest, earliest); small enough to broadcast whatever the input."""
    return commits.agg(F.max("ts").alias("latest"), F.min("ts").alias("earliest"))


def seconds_before(n: int) -> Column:
    return F.col("latest") - F.expr(f"INTERVAL {n * DAY} SECONDS")


def file_history(changes: DataFrame, recent_days: int = 90) -> DataFrame:
    """(path, commits, authors, churn, recent_commits, first_seen, last_changed); recent: at or after latest - recent_days.

    Commits are counted as rows by (path, commit), authors as rows by (path, author), so that no distinct
    count multiplies rows; null commits and authors count for nothing.
    """
    per = changes.groupBy("path", "commit").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    at = per.crossJoin(F.broadcast(latest(changes)))
    known = F.col("commit").isNotNull()
    found = at.groupBy("path").agg(
        F.count("commit").alias("commits"),
        F.sum("churn").alias("churn"),
        F.count_if(known & (F.col("last") >= seconds_before(recent_days))).alias("recent_commits"),
        F.min("first").alias("first_seen"),
        F.max("last").alias("last_changed"),
    )
    people = changes.groupBy("path", "author").agg(F.lit(1).alias("one")).groupBy(F.col("path").alias("of")).agg(F.count("author").alias("authors"))
    return found.join(people, F.col("path").eqNullSafe(F.col("of"))).select("path", "commits", "authors", "churn", "recent_commits", "first_seen", "last_changed")


def contributors(commits: DataFrame) -> DataFrame:
    """(author, commits, first_commit, last_commit, active_days)."""
    return commits.groupBy("author").agg(
        F.count("*").alias("commits"), F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"), F.count_distinct(F.to_date("ts")).alias("active_days")
    )


def display_names(commits: DataFrame) -> DataFrame:
    """(author, name): the most frequent name, of equals the smallest."""
    n = commits.groupBy("author", "name").count()
    return n.groupBy("author").agg(F.min_by("name", F.struct(-F.col("count"), "name")).alias("name"))


def ownership(people: DataFrame) -> DataFrame:
    """(contributors, contributors_for_half, top_share) of (author, commits): how few made half of all commits.

    Who has as many commits counts alike, so that the ordered step sees one row for each different number.
    """
    by_count = people.filter("commits is not null").groupBy("commits").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("commits")).rowsBetween(Window.unboundedPreceding, 0)
    run = by_count.select("commits", "n", F.sum("n").over(order).alias("heads"), F.sum(F.col("n") * F.col("commits")).over(order).alias("reached"), F.sum(F.col("n") * F.col("commits")).over(Window.partitionBy()).alias("total"))
    # of those with this number, as many as are needed after all with more
    needed = F.col("heads") - F.col("n") + F.ceil((F.col("total") / 2 - (F.col("reached") - F.col("n") * F.col("commits"))) / F.col("commits"))
    return run.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("contributors"),
        F.min(F.when((2 * F.col("reached") >= F.col("total")) & (2 * (F.col("reached") - F.col("n") * F.col("commits")) < F.col("total")), needed)).cast("long").alias("contributors_for_half"),
        round4(F.max("commits") / F.max("total")).alias("top_share"),
    )


def activity(commits: DataFrame, reference: Column) -> DataFrame:
    """Commits in the 30, 90 and 365 days up to a reference time, days since the last one and a level; later ones are counted apart."""
    ts, ref = F.col("ts"), F.col("reference")
    within = lambda d: F.count_if((ts >= ref - F.expr(f"INTERVAL {d * DAY} SECONDS")) & (ts <= ref))
    return (
        commits.withColumn("reference", reference)
        .agg(
            within(30).alias("last_30"), within(90).alias("last_90"), within(365).alias("last_365"), F.count("*").alias("total"),
            F.count_if(ts > ref).alias("future_dated"), F.min(F.when(ts <= ref, days_until(ts, ref))).alias("days_since_last"),
        )
        .withColumn("level", activity_level(F.col("last_30"), F.col("last_90"), F.col("last_365"), F.col("total")))
    )


def timeline(commits: DataFrame, most: int = 1200) -> DataFrame:
    """(month, commits, authors) without gaps between the first and the last month; over `most` months only those with commits."""
    found = commits.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("commits"), F.count_distinct("author").alias("authors"))
    span = found.agg(F.min("month").alias("a"), F.max("month").alias("b")).filter("a is not null and months_between(b, a) < {}".format(most))
    every = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return every.join(found, "month", "full").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("authors", F.lit(0)).alias("authors"))


def daily(commits: DataFrame) -> DataFrame:
    """(day, commits) for each day from the first to the last."""
    found = commits.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("commits"))
    every = found.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null").select(F.explode(F.expr("sequence(a, b)")).alias("day"))
    return every.join(found, "day", "left").select("day", F.coalesce("commits", F.lit(0)).alias("commits"))


def weekday_hour(commits: DataFrame, offset_minutes: Column | None = None) -> DataFrame:
    """(weekday from Monday = 0, hour, commits) for all 168 hours, in the author's own time."""
    own = F.col("ts") if offset_minutes is None else F.timestamp_seconds(F.unix_timestamp("ts") + offset_minutes * 60)
    found = commits.groupBy(F.weekday(own).alias("weekday"), F.hour(own).alias("hour")).agg(F.count("*").alias("commits"))
    every = commits.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return every.join(F.broadcast(found), ["weekday", "hour"], "left").select("weekday", "hour", F.coalesce("commits", F.lit(0)).alias("commits"))


def after_last(commits: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """commits with `last`, the (ts, commit) before each within its group, null for the first.

    Groups are windows. All commits as one group are put in order by month, where the first of a month
    follows the last of the months before, so that no task orders all.
    """
    here = F.struct("ts", "commit")
    if by:
        return commits.withColumn("last", F.lag(here).over(Window.partitionBy(*by).orderBy("ts", "commit")))
    dated = commits.withColumn("__month", F.date_trunc("month", "ts"))
    months = dated.groupBy(F.col("__month").alias("__of")).agg(F.max(here).alias("__end"))
    months = months.select("__of", F.max("__end").over(Window.orderBy(F.asc_nulls_first("__of")).rowsBetween(Window.unboundedPreceding, -1)).alias("__end"))
    within = F.lag(here).over(Window.partitionBy("__month").orderBy("ts", "commit"))
    joined = dated.withColumn("__here", within).join(months, F.col("__month").eqNullSafe(F.col("__of")))
    return joined.withColumn("last", F.coalesce("__here", "__end")).drop("__month", "__of", "__here", "__end")


def dormant_periods(commits: DataFrame, days: int = 60, most: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Pauses of so many days of 86,400 seconds or more between neighbours by (ts, commit); the longest are kept."""
    gap = F.unix_timestamp("end") - F.unix_timestamp("start")
    return (
        after_last(commits, by).select(*by, F.col("last.ts").alias("start"), F.col("ts").alias("end"), F.col("last.commit").alias("before"), F.col("commit").alias("after"))
        .filter(gap >= days * DAY)
        .withColumn("days", F.floor(gap / DAY))
        .orderBy(F.desc("days"), "start", *by)
        .limit(most)
    )


def epochs(commits: DataFrame, gap_days: int = 90, by: tuple[str, ...] = ()) -> DataFrame:
    """Periods between pauses of gap_days whole days, with commits, authors, span, rate and kind.

    Kinds: the last is current, the first initial, others active with a rate of 80 % or more of the
    upper median, else maintenance. A commit belongs to the period of the last pause that ends with it or
    before it; without groups, pauses are few and are met as an array, not by a window over all commits.
    """
    pause = F.floor((F.unix_timestamp("ts") - F.unix_timestamp("last.ts")) / DAY) >= gap_days
    marked = after_last(commits, by).withColumn("new", F.coalesce(pause, F.lit(False)))
    if by:
        run = Window.partitionBy(*by).orderBy("ts", "commit").rowsBetween(Window.unboundedPreceding, 0)
        marked = marked.withColumn("epoch", F.sum(F.col("new").cast("int")).over(run))
    else:  # two pauses are gap_days apart, so that a span of years has a few dozen
        starts = marked.agg(F.array_sort(F.collect_set(F.when(F.col("new"), F.col("ts")))).alias("starts"))
        marked = marked.crossJoin(F.broadcast(starts)).withColumn("epoch", F.size(F.filter("starts", lambda t: t <= F.col("ts"))).cast("long"))
    found = marked.groupBy(*by, "epoch").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("commits"), F.count_distinct("author").alias("authors"))
    span = F.greatest(F.floor((F.unix_timestamp("end") - F.unix_timestamp("start")) / DAY), F.lit(1))
    all_, ranked = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("rate", "epoch")
    found = found.withColumn("rate", F.col("commits") * 30.0 / span).withColumn("n", F.count("*").over(all_)).withColumn("r", F.row_number().over(ranked))
    found = found.withColumn("median", F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("rate"))).over(all_))
    kind = F.when(F.col("epoch") == F.col("n") - 1, "current").when(F.col("epoch") == 0, "initial").when(F.col("rate") >= 0.8 * F.col("median"), "active").otherwise("maintenance")
    return found.select(*by, "epoch", "start", "end", "commits", "authors", round4(F.col("rate")).alias("rate"), kind.alias("kind"))


def split_by_year(commits: DataFrame, longer_than: int = 540, least: int = 90) -> DataFrame:
    """(epoch, part, start, end, commits) from commits(epoch, ts): long epochs are cut at years, short parts join the one before.

    Whether a part joins depends on what the parts before it have become, so a fold runs over an
    epoch's years, of which there are few.
    """
    years = commits.groupBy("epoch", F.year("ts").alias("year")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("commits"))
    parts = years.groupBy("epoch").agg(F.array_sort(F.collect_list(F.struct("start", "end", "commits"))).alias("parts"))
    span = lambda a, b: F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / DAY)
    long = span(F.element_at("parts", 1)["start"], F.element_at("parts", -1)["end"]) > longer_than
    joined = lambda p, x: F.struct(p["start"].alias("start"), x["end"].alias("end"), (p["commits"] + x["commits"]).alias("commits"))
    empty = F.array().cast("array<struct<start:timestamp,end:timestamp,commits:bigint>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        join = F.size(done).__gt__(0) & (~F.col("long") | (span(x["start"], x["end"]) < least) | (span(last["start"], last["end"]) < least))
        return F.when(join, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined(last, x)))).otherwise(F.array_append(done, x))

    folded = parts.withColumn("long", long).withColumn("done", F.aggregate("parts", empty, step))
    return folded.select("epoch", F.posexplode("done").alias("part", "x")).select("epoch", "part", "x.start", "x.end", "x.commits")


def areas(changes: DataFrame) -> DataFrame:
    """(area, commits, churn, files): a change counts for one or two areas, a commit once an area.

    Changes are summed by (commit, path) before they are spread over areas; commits are counted as rows
    by (area, commit), files from the different paths. Both sums are dealt into parts of bounded size.
    """
    n = part_count(changes)
    per = changes.repartition(n, "commit", "path").groupBy("commit", "path").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"))
    spread = lambda df, *keep: df.select(*keep, F.explode(activity_areas(F.col("path"))).alias("area"))
    by_commit = spread(per, "commit", "churn").repartition(n, "area", "commit").groupBy("area", "commit").agg(F.sum("churn").alias("churn"))
    found = by_commit.groupBy("area").agg(F.count("commit").alias("commits"), F.sum("churn").alias("churn"))
    files = spread(changes.select("path").distinct()).groupBy(F.col("area").alias("of")).agg(F.count("*").alias("files"))
    return found.join(files, F.col("area") == F.col("of")).select("area", "commits", "churn", "files")


def high_churn_areas(found: DataFrame, least: float = 0.2, most: int = 5) -> DataFrame:
    """Areas with such a share of all churn of the most specific kind: none below them has one too."""
    total = found.filter(~F.col("area").contains("/")).agg(F.sum("churn").alias("total"))
    high = found.crossJoin(F.broadcast(total)).withColumn("share", round4(F.col("churn") / F.col("total"))).filter(F.col("share") >= least)
    below = high.select(F.substring_index("area", "/", 1).alias("area"), F.col("area").alias("own")).filter("area != own").select("area").distinct()
    return high.join(below, "area", "left_anti").select("area", "churn", "share").orderBy(F.desc("share"), "area").limit(most)


def abandoned_areas(history: DataFrame, days: int = 365, files: int = 3, most: int = 30) -> DataFrame:
    """(area, last_changed, files, days) of areas that have not changed so long before the latest change."""
    at = history.agg(F.max("last_changed").alias("latest"))
    found = history.groupBy(area_of(F.col("path")).alias("area")).agg(F.max("last_changed").alias("last_changed"), F.count("*").alias("files"))
    found = found.crossJoin(F.broadcast(at)).withColumn("days", days_until(F.col("last_changed"), F.col("latest")))
    return found.filter((F.col("area") != "(root)") & (F.col("days") >= days) & (F.col("files") >= files)).drop("latest").orderBy(F.desc("days"), "area").limit(most)


def module_ages(members: DataFrame, history: DataFrame) -> DataFrame:
    """(module, first_commit, last_change, age_days, recent_share, class) of members(module, path) with a history."""
    at = history.agg(F.min("first_seen").alias("start"), F.max("last_changed").alias("latest"))
    found = members.join(history, "path").groupBy("module").agg(F.min("first_seen").alias("first_commit"), F.max("last_changed").alias("last_change"), F.sum("commits").alias("commits"), F.sum("recent_commits").alias("recent"))
    age, offset = days_until(F.col("first_commit"), F.col("latest")), days_until(F.col("start"), F.col("first_commit"))
    span = F.greatest(days_until(F.col("start"), F.col("latest")), F.lit(1))
    share = F.coalesce(F.col("recent") / F.nullif("commits", F.lit(0)), F.lit(0.0))
    kind = F.when(age <= 30, "new").when(age <= 365, "recent").when(share >= 0.3, "growing").when((offset * 5 <= span) & (age > 730), "ancient").otherwise("established")
    return found.crossJoin(F.broadcast(at)).select("module", "first_commit", "last_change", age.alias("age_days"), round4(share).alias("recent_share"), kind.alias("class"))


def recent_changes(changes: DataFrame, days: int = 90) -> DataFrame:
    """(commits, authors, files, churn) of what came after latest - days, the bound itself left out."""
    at = changes.crossJoin(F.broadcast(latest(changes))).filter(F.col("ts") > seconds_before(days))
    return at.agg(F.count_distinct("commit").alias("commits"), F.count_distinct("author").alias("authors"), F.count_distinct("path").alias("files"), F.coalesce(F.sum(F.col("added") + F.col("deleted")), F.lit(0)).alias("churn"))


def numbered(df: DataFrame, ts: str, *ties: str, name: str = "position") -> DataFrame:
    """df with each row's place by (ts, ties), from 1: places within a month on top of the counts of the months before.

    So no task orders all rows; a row without a time comes before all others, and months are few.
    """
    dated = df.withColumn("__month", F.date_trunc("month", ts))
    counts = dated.groupBy("__month").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(F.asc_nulls_first("__month")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__month").alias("__of"), before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__month").orderBy(F.asc_nulls_first(ts), *ties))
    return dated.withColumn("__row", within).join(counts, F.col("__month").eqNullSafe(F.col("__of"))).withColumn(name, F.col("__row") + F.col("__before")).drop("__month", "__of", "__row", "__before")


def releases(tags: DataFrame, commits: DataFrame) -> DataFrame:
    """(tag, version, commit, ts, position, since_previous): commits since the release before that is in the history; below zero is 0.

    The release before is the last by (tag_ts, tag) in its month, or else the last of the months before.
    """
    known = numbered(commits.select("commit", "ts"), "ts", "commit")
    found = tags.withColumn("version", parse_version(F.col("tag"))).filter("version is not null").join(known, "commit", "left")
    found = found.withColumn("__month", F.date_trunc("month", "tag_ts"))
    here = F.last("position", ignorenulls=True).over(Window.partitionBy("__month").orderBy("tag_ts", "tag").rowsBetween(Window.unboundedPreceding, -1))
    place = F.struct("tag_ts", "tag")
    months = found.groupBy("__month").agg(F.max_by("position", F.when(F.col("position").isNotNull(), place)).alias("__last"))
    earlier = F.last("__last", ignorenulls=True).over(Window.orderBy("__month").rowsBetween(Window.unboundedPreceding, -1))
    months = months.select(F.col("__month").alias("__of"), earlier.alias("__earlier"))
    joined = found.withColumn("__here", here).join(months, F.col("__month").eqNullSafe(F.col("__of")))
    before = F.coalesce("__here", "__earlier", F.lit(0))
    return joined.withColumn("since_previous", F.greatest(F.col("position") - before, F.lit(0))).drop("__month", "__of", "__here", "__earlier")


def snapshots_as_of(commits: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, commit, ts): the last commit at or before each target time.

    Targets and commits are put in one order of time by month; each target takes the last commit of its
    month up to it, or the last of the months before, which running maxima over months give.
    """
    month = lambda c: F.date_trunc("month", c)
    both = commits.select(month("ts").alias("m"), "ts", "commit", F.lit(0).alias("kind")).union(targets.select(month("target"), "target", F.lit(None).cast("string"), F.lit(1)))
    within = Window.partitionBy("m").orderBy("ts", "kind", "commit").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("found", F.last(F.when(F.col("kind") == 0, F.struct("ts", "commit")), ignorenulls=True).over(within))
    months = here.groupBy("m").agg(F.max(F.when(F.col("kind") == 0, F.struct("ts", "commit"))).alias("last"))
    months = months.withColumn("before", F.max("last").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    out = here.filter("kind = 1").join(months, "m").withColumn("found", F.coalesce("found", "before"))
    return out.select(F.col("ts").alias("target"), "found.commit", F.col("found.ts").alias("ts"))


def spaced(n: Column, count: int) -> Column:
    """Indices of `count` places evenly spaced over n, the last included."""
    return F.when(n <= count, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.floor(i * n / count).cast("int") - 1))


def area_events(changes: DataFrame) -> DataFrame:
    """(area, event, ts, files, peak): areas that appear and that lose their last file, from changes(seq, ts, path, status).

    A file counts from when it is added until it is deleted; running sums over an area's changes give
    its files and their peak.
    """
    step = F.when(F.col("status") == "added", 1).when(F.col("status") == "deleted", -1).otherwise(0)
    order = Window.partitionBy("area").orderBy("seq", "path").rowsBetween(Window.unboundedPreceding, 0)
    run = changes.withColumn("area", area_of(F.col("path"))).withColumn("step", step).withColumn("files", F.sum("step").over(order)).withColumn("peak", F.max("files").over(order))
    first = F.row_number().over(Window.partitionBy("area").orderBy("seq", "path")) == 1
    run = run.withColumn("event", F.when(first & (F.col("files") > 0), "introduced").when((F.col("step") < 0) & (F.col("files") == 0), "removed"))
    return run.filter("event is not null").select("area", "event", "ts", "files", "peak")


def rename_chains(renames: DataFrame) -> DataFrame:
    """(seq, path, current) for renames(seq, old, new): what each old name is called at the end.

    A name that a rename gives is followed by the first later rename of it. Each round puts two stretches
    of every chain together, so that a chain of n renames takes about log2(n) rounds, until none moves.
    """
    from siltstone.functions.tables import discard, stored

    r = renames.select("seq", "old", "new")
    later = r.select(F.col("seq").alias("next"), F.col("old").alias("name"))
    follows = r.join(later, (r.new == later.name) & (later.next > r.seq), "left").groupBy("seq", F.col("old").alias("path"), F.col("new").alias("current")).agg(F.min("next").alias("next"))
    hops = stored(follows, "renames")
    while not hops.filter("next is not null").isEmpty():
        far = hops.select(F.col("seq").alias("at"), F.col("current").alias("further"), F.col("next").alias("after"))
        step = hops.join(far, hops.next == far["at"], "left").select("seq", "path", F.coalesce("further", "current").alias("current"), F.col("after").alias("next"))
        before, hops = hops, stored(step, "renames")
        discard(before)
    return hops.select("seq", "path", "current")


def file_states(changes: DataFrame) -> DataFrame:
    """(path, names, commits, churn, first_seen, last_changed, deleted) of each file under its last name.

    changes: (seq, commit, ts, path, old, status, added, deleted); a rename has its new name in path and the
    old one in old. A change counts for what its file is called at the end: the next rename of its path
    is looked up within the path, and where its chain ends by leaps of hops that carry numbers alone.
    deleted: the last change was a deletion. Rows of one path are put in order, never all rows; changes are
    read once beyond a count of them.
    """
    from siltstone.functions.tables import ROWS, discard, part_count, stored

    kind = changes.schema
    row = F.struct("path", F.lit(None).cast(kind["seq"].dataType).alias("rename"), "commit", "ts", (F.col("added") + F.col("deleted")).alias("churn"), "status")
    mark = F.struct(F.col("old").alias("path"), F.col("seq").alias("rename"), *(F.lit(None).cast(t).alias(c) for c, t in (("commit", kind["commit"].dataType), ("ts", kind["ts"].dataType), ("churn", "long"), ("status", "string"))))
    both = changes.select("seq", F.explode(F.when(F.col("status") == "renamed", F.array(row, mark)).otherwise(F.array(row))).alias("r")).select("seq", "r.*").repartition(part_count(changes, ROWS), "path")
    later = Window.partitionBy("path").orderBy(F.desc("seq"), F.col("rename").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    placed = both.withColumns({"mark": F.col("rename").isNotNull(), "next": F.last("rename", ignorenulls=True).over(later)}).filter("not mark").drop("mark", "rename")
    placed = stored(placed.withColumn("id", F.monotonically_increasing_id()), "placed")
    # a rename's own row stands under its new name, so that the next rename of that name follows it
    hops = placed.filter("status = 'renamed'").select("seq", "id", "next", F.col("path").alias("current"))
    ids = hops.select(F.col("seq").alias("next"), F.col("id").alias("to"))
    state = stored(hops.select("id", "next").join(ids, "next", "left").select("id", "to"), "hops")
    last = [stored(state.filter("to is null").select("id", F.col("id").alias("end")), "ends")]
    left = stored(state.filter("to is not null"), "hops")
    discard(state)
    while not left.isEmpty():
        # those whose next is an end are done; the others leap as far as their next does
        step = left.join(last[-1].withColumnRenamed("id", "to"), "to", "left").join(left.select(F.col("id").alias("to"), F.col("to").alias("further")), "to", "left")
        step = stored(step.select("id", "to", "end", "further"), "step")
        last.append(stored(last[-1].union(step.filter("end is not null").select("id", "end")), "ends"))
        before, left = left, stored(step.filter("end is null").select("id", F.col("further").alias("to")), "hops")
        discard(before, step, last[-2])
    ends = last[-1].join(hops.select(F.col("id").alias("end"), "current"), "end").select("id", "current").join(hops.select("id", F.col("seq").alias("next")), "id").select("next", "current")
    ends = stored(ends, "currents")
    called = lambda df: df.join(ends, "next", "left").withColumn("current", F.coalesce("current", "path")).filter("current is not null")
    # rows of one file lie in one part from here on, so that no more sums need a shuffle
    rows = called(placed).select("current", "commit", "churn", "ts", "seq", "status").repartition(part_count(placed, ROWS), "current")
    per = rows.groupBy("current", "commit").agg(F.sum("churn").alias("churn"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max(F.struct("seq", "status")).alias("end"))
    files = per.groupBy("current").agg(F.count("commit").alias("commits"), F.sum("churn").alias("churn"), F.min("first").alias("first_seen"), F.max("last").alias("last_changed"), (F.max("end")["status"] == "deleted").alias("deleted"))
    names = called(placed.select("path", "next").distinct()).select("current", "path").distinct().groupBy("current").agg(F.count("*").alias("names"))
    return files.join(names, "current").select(F.col("current").alias("path"), "names", "commits", "churn", "first_seen", "last_changed", "deleted")


def snapshots(changes: DataFrame, targets: list, by: str = "language") -> DataFrame:
    """(target, by, files, lines) at each of a few times: what has been added less what has been deleted up to it.

    changes: (ts, status, added, deleted, by). Each change falls to the first target at or after it, counts
    go by target, and sums run over targets alone.
    """
    times = F.array(*(F.lit(t).cast("timestamp") for t in sorted(targets)))
    place = F.size(F.filter(times, lambda t: t < F.col("ts")))
    step = F.when(F.col("status") == "added", 1).when(F.col("status") == "deleted", -1).otherwise(0)
    n = changes.select(by, place.alias("k"), step.alias("step"), (F.col("added") - F.col("deleted")).alias("grown")).filter(F.col("k") < len(targets))
    n = n.groupBy(by, "k").agg(F.sum("step").alias("step"), F.sum("grown").alias("grown"))
    every = n.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(len(targets) - 1))).alias("k"))
    run = Window.partitionBy(by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    out = every.join(n, [by, "k"], "left").select("k", by, F.sum(F.coalesce("step", F.lit(0))).over(run).alias("files"), F.sum(F.coalesce("grown", F.lit(0))).over(run).alias("lines"))
    return out.select(F.get(times, F.col("k")).alias("target"), by, "files", "lines").filter("files != 0 or lines != 0")


# Kinds of events, in the order in which those of one time are told.
EVENTS = (
    "repository-created", "multi-package-structure", "module-introduced", "module-removed", "restructuring", "tests-introduced", "ci-adopted", "containers-adopted",
    "framework-adopted", "framework-removed", "language-introduced", "language-shift", "significant-growth", "significant-reduction", "release",
)


def told(events: DataFrame) -> DataFrame:
    """events(ts, kind, subject) in the order of their times and kinds."""
    rank = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("kind"))
    return events.orderBy("ts", rank, "subject")


def snapshot_events(found: DataFrame, by: str = "language") -> DataFrame:
    """(ts, kind, subject, before, after): what changes from each snapshot to the next, from snapshots(target, by, files, lines).

    A language is introduced when its share of the lines goes from under 5 % to 10 % or more, and shifts
    when it had 5 % and moves by 20 points or more. The files grow significantly by 50 and a half, and
    shrink by 30 and three tenths. Snapshots are few, so that windows run over them by language.
    """
    whole = Window.partitionBy("target")
    share = found.select("target", by, (F.col("lines") / F.nullif(F.sum("lines").over(whole), F.lit(0))).alias("share"))
    times = found.select("target").distinct()
    every = times.crossJoin(F.broadcast(found.select(by).distinct())).join(share, ["target", by], "left").na.fill(0.0, ["share"])
    before = F.lag("share").over(Window.partitionBy(by).orderBy("target"))
    pairs = every.withColumn("before", before).filter("before is not null")
    kind = F.when((F.col("before") < 0.05) & (F.col("share") >= 0.1), "language-introduced").when((F.col("before") >= 0.05) & (F.col("share") > 0) & (F.abs(F.col("share") - F.col("before")) >= 0.2), "language-shift")
    languages = pairs.select(F.col("target").alias("ts"), kind.alias("kind"), F.col(by).cast("string").alias("subject"), round4(F.col("before")).alias("before"), round4(F.col("share")).alias("after")).filter("kind is not null")
    files = found.groupBy("target").agg(F.sum("files").alias("b"))
    files = files.withColumn("a", F.lag("b").over(Window.orderBy("target"))).filter("a is not null")
    a, b = F.col("a"), F.col("b")
    kind = F.when((b >= a + 50) & (b * 2 >= a * 3), "significant-growth").when((a >= b + 30) & (b * 10 <= a * 7), "significant-reduction")
    sizes = files.select(F.col("target").alias("ts"), kind.alias("kind"), F.lit("repository").alias("subject"), a.cast("double").alias("before"), b.cast("double").alias("after")).filter("kind is not null")
    return languages.unionByName(sizes)


def first_appearances(changes: DataFrame, tests: dict[str, Column], renames: int = 20) -> DataFrame:
    """(ts, kind, subject): the first commit, the first file of each kind after it, and commits that rename many files.

    changes: (seq, commit, ts, path, status). tests: what a path must be for each kind; a kind that the
    first commit has already is no event.
    """
    per = changes.groupBy("commit").agg(F.min("seq").alias("seq"), F.min("ts").alias("ts"), F.count_if(F.col("status") == "renamed").alias("renamed"), *(F.bool_or(test & (F.col("status") != "deleted")).alias(kind) for kind, test in tests.items()))
    first = per.agg(F.min("seq").alias("start"))
    per = per.crossJoin(F.broadcast(first))
    at = F.struct("seq", "ts", F.col("commit").cast("string").alias("subject"))
    starts = per.agg(F.min(at).alias("created"), *(F.min(F.when(F.col(kind), at)).alias(kind) for kind in tests), F.min("start").alias("start"))
    row = lambda kind, c: F.when((F.lit(kind == "repository-created")) | (F.col(c)["seq"] > F.col("start")), F.struct(F.col(c)["ts"].alias("ts"), F.lit(kind).alias("kind"), F.col(c)["subject"].alias("subject")))
    once = starts.select(F.explode(F.array_compact(F.array(row("repository-created", "created"), *(row(kind, kind) for kind in tests)))).alias("e")).select("e.*").filter("ts is not null")
    moved = per.filter((F.col("renamed") >= renames) & (F.col("seq") > F.col("start"))).select("ts", F.lit("restructuring").alias("kind"), F.col("commit").cast("string").alias("subject"))
    return once.unionByName(moved)


def commit_sizes(changes: DataFrame) -> DataFrame:
    """(commit, files, insertions, deletions) of changes(commit, path, added, deleted)."""
    return changes.groupBy("commit").agg(F.count("*").alias("files"), F.sum("added").alias("insertions"), F.sum("deleted").alias("deletions"))
