"""Rosters and players: parsing of pasted lists, tiers of matches, duplicates, recipients, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtlake.functions.names import file_stem, near_name, norm_name, public_caption

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def parse_roster(lines: DataFrame) -> DataFrame:
    """line, name, email, skipped of each line of pasted lists (list_id, line, text).

    The first line of a list tells its delimiter (tabs beat commas only by number) and, if it names an e-mail column,
    the columns; else the first column of it that is an address is taken and the line counts as data. Fields may be
    quoted. Lines without an address, and those that repeat one, are skipped.
    """
    text = F.trim("text")
    rows = lines.where(F.coalesce(text, F.lit("")) != "").select("list_id", "line", text.alias("text"))
    w = Window.partitionBy("list_id").orderBy("line")
    rows = rows.withColumn("_head", F.first("text").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    count = lambda c: F.length("_head") - F.length(F.replace(F.col("_head"), F.lit(c), F.lit("")))
    rows = rows.withColumn("_tab", count("\t") > count(","))

    def fields(t: Column) -> Column:
        # cut at delimiters that an even number of quotes follows
        cut = F.when(F.col("_tab"), F.split(t, "\t(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")).otherwise(F.split(t, ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
        return F.transform(cut, lambda x: F.trim(F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"'))))

    rows = rows.withColumn("_h", F.transform(fields(F.col("_head")), F.lower)).withColumn("_f", fields(F.col("text")))
    place = lambda fn: F.array_position(F.transform("_h", lambda h: F.coalesce(fn(h), F.lit(False))), True)
    rows = rows.withColumn("_mail", place(lambda h: h.rlike("e-?mail"))).withColumn("_has", F.col("_mail") > 0)
    rows = rows.withColumn("_mail", F.when(F.col("_has"), F.col("_mail")).otherwise(place(lambda h: h.rlike(EMAIL))))
    named = place(lambda h: h.rlike("name") & ~h.rlike("first|last|user|file"))
    other = F.array_position(F.transform("_h", lambda h, i: (h != "") & (i + 1 != F.col("_mail"))), True)
    rows = rows.withColumn("_name", F.when(F.col("_has") | (named > 0), named).otherwise(other)).where(~(F.col("_first") & F.col("_has")) & (F.col("_mail") > 0))
    get = lambda at: F.coalesce(F.get("_f", (at - 1).cast("int")), F.lit(""))
    whole = F.trim(F.concat_ws(" ", get(place(lambda h: h.rlike("first"))), get(place(lambda h: h.rlike("last")))))
    name = F.when((F.col("_name") > 0) & (get(F.col("_name")) != ""), get(F.col("_name"))).otherwise(whole)
    rows = rows.select("list_id", "line", name.alias("name"), F.lower(get(F.col("_mail"))).alias("email"))
    again = F.row_number().over(Window.partitionBy("list_id", "email").orderBy("line")) > 1
    return rows.withColumn("skipped", ~F.col("email").rlike(EMAIL) | again)


def _cuts(name: Column) -> Column:
    """The name, and what is left of it without each of its letters: two names one edit apart share one of these."""
    return F.array_distinct(F.concat(F.array(name), F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))))


def duplicate_players(players: DataFrame) -> DataFrame:
    """a, b, reason: players of the same normalised name, or else whose names as displayed differ by one edit, case apart. Blank names are nobody's.

    Pairs come from equi-joins on the normalised name and on names without one letter, never from all pairs.
    """
    rows = players.select("player_id", norm_name(F.col("name")).alias("n"), F.lower("name").alias("l")).where("n <> ''")

    def pairs(key: Column) -> DataFrame:
        keyed = rows.withColumn("_k", key)
        a, b = (keyed.select("_k", F.col("player_id").alias(x), F.col("n").alias(f"n{x}"), F.col("l").alias(f"l{x}")) for x in "ab")
        return a.join(b, "_k").where("a < b").drop("_k")

    same = pairs(F.col("n")).select("a", "b", F.lit("same name").alias("reason"))
    near = pairs(F.explode(_cuts(F.col("l")))).where("na <> nb").distinct().where(near_name(F.col("la"), F.col("lb"))).select("a", "b", F.lit("similar name").alias("reason"))
    return same.unionByName(near)


def match_roster(rows: DataFrame, players: DataFrame, links: DataFrame) -> DataFrame:
    """email, player_id, reason, candidates: each row's player by the first tier that finds any.

    Tiers: an existing link, the same normalised name, a name one edit away, the same first word. More than one match
    is ambiguous, and one that another address has is claimed. One equi-join for each tier.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    r = rows.select("email", "name", norm_name(F.col("name")).alias("_n"), low("name").alias("_l"))
    p = players.select("player_id", norm_name(F.col("name")).alias("_n"), low("name").alias("_l"))
    first = lambda c: F.element_at(F.split(c, " "), 1)
    named = r.where("_n <> ''")
    exact = named.join(p.select("_n", "player_id"), "_n").select("email", "player_id", F.lit(2).alias("tier"))
    typo = named.select("email", "_l", F.explode(_cuts(F.col("_l"))).alias("_k")).join(p.select("player_id", F.col("_l").alias("_pl"), F.explode(_cuts(F.col("_l"))).alias("_k")), "_k")
    typo = typo.where(near_name(F.col("_l"), F.col("_pl"))).select("email", "player_id", F.lit(3).alias("tier")).distinct()
    word = named.withColumn("_w", first(F.col("_n"))).join(p.select(first(F.col("_n")).alias("_w"), "player_id"), "_w").select("email", "player_id", F.lit(4).alias("tier"))
    linked = r.join(links.select(F.lower("email").alias("email"), "player_id"), "email").select("email", "player_id", F.lit(1).alias("tier"))
    found = linked.unionByName(exact).unionByName(typo).unionByName(word)
    best = found.withColumn("_t", F.min("tier").over(Window.partitionBy("email"))).where("tier = _t").groupBy("email").agg(F.min("tier").alias("tier"), F.sort_array(F.collect_set("player_id")).alias("candidates"))
    one = F.size("candidates") == 1
    claimed = links.select(F.col("player_id").alias("_p"), F.lower("email").alias("_owner")).groupBy("_p").agg(F.max("_owner").alias("_owner"))
    out = r.select("email").join(best, "email", "left").withColumn("_p", F.when(one, F.element_at("candidates", 1))).join(claimed, "_p", "left")
    taken = (F.col("tier") > 1) & F.col("_owner").isNotNull() & (F.col("_owner") != F.col("email"))
    word_of = F.create_map(*(F.lit(x) for kv in ((1, "linked"), (2, "exact"), (3, "typo"), (4, "first-name")) for x in kv))
    reason = F.when(F.col("tier").isNull(), "none").when(~one, "ambiguous").when(F.coalesce(taken, F.lit(False)), "claimed").otherwise(word_of[F.col("tier")])
    return out.select("email", F.when(reason.isin("linked", "exact", "typo", "first-name"), F.col("_p")).alias("player_id"), reason.alias("reason"), F.coalesce("candidates", F.expr("cast(array() as array<bigint>)")).alias("candidates"))


def recipients(users: DataFrame, identities: DataFrame, rallies: DataFrame, plays: DataFrame, ledger: DataFrame) -> DataFrame:
    """played_on, player_id, email, touches, sent: players with an address and a touch that night, and whether they got their mail."""
    people = identities.where("player_id is not null").select("game_id", "cluster_id", "player_id")
    touched = plays.where("cluster_id is not null").join(rallies.select("rally_id", "game_id", "played_on"), "rally_id").join(people, ["game_id", "cluster_id"]).groupBy("played_on", "player_id").agg(F.count(F.lit(1)).alias("touches"))
    sent = ledger.select("player_id", "played_on", F.lit(True).alias("sent")).distinct()
    return touched.join(users.select("player_id", "email"), "player_id").join(sent, ["player_id", "played_on"], "left").select("played_on", "player_id", "email", "touches", F.coalesce("sent", F.lit(False)).alias("sent"))


def match_bundles(games: DataFrame, files: DataFrame) -> DataFrame:
    """game_id, file: the file whose normalised stem is the game's name, else the first that contains it or is contained.

    A text contains another if one of its pieces is equal to it, so all comes from equi-joins: pieces are cut in the
    lengths that the other side has, and each keeps its first file alone before it is joined.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    g = games.select("game_id", flat(F.col("name")).alias("_g"))
    stem = F.regexp_replace(F.regexp_replace(F.lower("file"), r"^.*[/\\]", ""), r"^game_bundle[-_ ]?|\.[^.]*$", "")
    f = files.select("file", flat(stem).alias("_f")).groupBy("_f").agg(F.min("file").alias("file"))
    # one row: the distinct lengths of a side's texts
    lengths = lambda rows, c: F.broadcast(rows.agg(F.collect_set(F.length(c)).alias("_lengths")))
    cut = lambda c: F.array_distinct(F.flatten(F.transform("_lengths", lambda n: F.when(n <= F.length(c), F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>")))))
    exact = g.join(f, F.col("_g") == F.col("_f")).select("game_id", "file").groupBy("game_id").agg(F.min("file").alias("file"))
    rest = g.join(exact, "game_id", "left_anti")
    pieces = f.crossJoin(lengths(g, "_g")).select("file", F.explode(cut("_f")).alias("_g")).groupBy("_g").agg(F.min("file").alias("file"))
    # pieces are many more than the planner sees, so none are broadcast
    inside = rest.join(pieces.hint("merge"), "_g").select("game_id", "file")
    around = rest.crossJoin(lengths(f, "_f")).select("game_id", F.explode(cut("_g")).alias("_f")).join(f.hint("merge"), "_f").select("game_id", "file")
    return exact.unionByName(inside.unionByName(around).groupBy("game_id").agg(F.min("file").alias("file")))


def reel(shorts: DataFrame, games: DataFrame, n: int = 12) -> DataFrame:
    """short_id, video_id, caption of the `n` newest published shorts that are online and whose game is public, undated last; captions without surnames."""
    shown = shorts.where("status = 'published' and video_id is not null").join(games.where("published").select("game_id"), "game_id")
    newest = shown.orderBy(F.col("published_at").desc_nulls_last(), F.desc("short_id")).limit(n)
    return newest.select("short_id", "video_id", public_caption(F.col("caption")).alias("caption"))


def recent_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    """All unfinished jobs and the newest `n` finished ones."""
    done = jobs.where(F.col("status").isin("done", "failed")).orderBy(F.desc("updated_at"), F.desc("job_id")).limit(n)
    return jobs.where(~F.col("status").isin("done", "failed")).unionByName(done)


def queue_rollup(jobs: DataFrame) -> DataFrame:
    """batch, pending, done, failed, open: what is left of each batch of jobs."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return jobs.groupBy("batch").agg(of("pending"), of("done"), of("failed"), (F.count_if(F.col("status") == "pending") > 0).alias("open"))


def recap_nights(games: DataFrame, ledger: DataFrame) -> DataFrame:
    """played_on, games, sent: nights of published games, newest first, and how many mails of the ledger went out for each."""
    sent = ledger.groupBy("played_on").agg(F.count(F.lit(1)).alias("sent"))
    nights = games.where("published and played_on is not null").groupBy("played_on").agg(F.count(F.lit(1)).alias("games"))
    return nights.join(sent, "played_on", "left").na.fill(0, ["sent"]).orderBy(F.desc("played_on"))


def newest_first(games: DataFrame) -> DataFrame:
    """Published games by night, the latest first and undated ones last, the last game of a night first."""
    return games.where("published").orderBy(F.col("played_on").desc_nulls_last(), F.col("slot").desc_nulls_last(), F.desc("game_id"))


def review_order(tracklets: DataFrame) -> DataFrame:
    """game_id, tracklet_id, place: a game's tracklets as its review lists them, most typical first, those without a figure as -1, then by start."""
    w = Window.partitionBy("game_id").orderBy(F.coalesce("typicality", F.lit(-1.0)).desc(), "t0", "tracklet_id")
    return tracklets.select("game_id", "tracklet_id", F.row_number().over(w).cast("long").alias("place"))


def pool(sources: dict[str, DataFrame]) -> DataFrame:
    """The rows of several sources under each other, with the source's name; columns that one lacks are null there."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def unprocessed(videos: DataFrame, bundles: DataFrame) -> DataFrame:
    """Videos (file) of which there is no bundle game_bundle_<stem>.zip (file)."""
    done = bundles.select(F.regexp_replace(file_stem(F.col("file")), "^game_bundle_", "").alias("_stem")).distinct()
    return videos.withColumn("_stem", file_stem(F.col("file"))).join(done, "_stem", "left_anti").drop("_stem")


def pending_work(shorts: DataFrame, posts: DataFrame) -> DataFrame:
    """game_id, renders, posts, busy: shorts of a game that wait or render, and posts of them that wait or go out."""
    renders = shorts.groupBy("game_id").agg(F.count_if(F.col("status").isin("queued", "rendering")).alias("renders"))
    out = posts.where(F.col("status").isin("queued", "posting")).join(shorts.select("short_id", "game_id"), "short_id").groupBy("game_id").agg(F.count(F.lit(1)).alias("posts"))
    return renders.join(out, "game_id", "left").na.fill(0, ["posts"]).withColumn("busy", F.col("renders") + F.col("posts") > 0)


def reap_stale(jobs: DataFrame, now: Column, after: str = "3 minutes") -> DataFrame:
    """Staging jobs that were silent for longer than `after` fail."""
    stale = (F.col("status") == "staging") & (F.col("updated_at") < now - F.expr(f"INTERVAL {after}"))
    return jobs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))
