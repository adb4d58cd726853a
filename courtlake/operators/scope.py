"""Scopes, live identities, merge chains, review progress and label documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtlake.functions import names as n
from courtlake.sources.store import written


def live_identities(identities: DataFrame) -> DataFrame:
    """Identities that are neither dismissed nor merged; unnamed ones are called P and their cluster's number."""
    name = F.coalesce("name", F.concat(F.lit("P"), F.col("cluster_id").cast("string")))
    return identities.where("not dismissed and merged_into is null").withColumn("name", name).drop("dismissed", "merged_into")


def scope(tables: dict[str, DataFrame], game_id: int | None = None, day: str | None = None) -> dict[str, DataFrame]:
    """Public tables: published games of a night, of one game (which wins) or of one day; game-phase rallies, kept touches.

    Predicates stand before the joins; touches are left to be joined by their rally.
    """
    games = tables["games"].where("published and played_on is not null")
    if game_id is not None:
        games = games.where(F.col("game_id") == game_id)
    elif day is not None:
        games = games.where(F.col("played_on") == F.lit(day).cast("date"))
    rallies = tables["rallies"].where("phase = 'game'").join(games.select("game_id", "played_on"), "game_id").withColumn("duration", F.col("end_s") - F.col("start_s"))
    return tables | {"games": games, "rallies": rallies, "plays": tables["plays"].where("not deleted"), "identities": live_identities(tables["identities"])}


def _followed(to: DataFrame) -> DataFrame:
    """id, to, ends of pointers doubled until every chain that ends has reached its end (`ends`); the others run into cycles.

    A round doubles how far each pointer reaches, so while a chain of any length isn't done, some of its rows become so;
    the driver sees two counts a round.
    """
    last = None
    while True:
        open_ = to.agg(F.count_if(~F.col("ends"))).first()[0]
        if not open_ or open_ == last:
            return to
        last = open_
        next_ = to.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("ends").alias("_ends"))
        to = written(to.join(next_, "to", "left").select("id", F.coalesce("_to", "to").alias("to"), (F.col("ends") | F.coalesce("_ends", F.lit(True))).alias("ends")), "merges")


def resolve_merges(identities: DataFrame) -> DataFrame:
    """game_id, cluster_id, survivor: the cluster at the end of each identity's chain of merges, however long.

    A chain that runs into a cycle ends where it enters it, so rows of a cycle keep their own cluster, as do those whose
    chain leads to an identity that isn't there.
    """
    ids = identities.select(F.col("identity_id").alias("id"), F.coalesce("merged_into", "identity_id").alias("to"))
    known = ids.select(F.col("id").alias("to"), F.lit(True).alias("_known"))
    first = written(ids.join(known, "to", "left").select("id", "to", ((F.col("id") == F.col("to")) | F.col("_known").isNull()).alias("ends")), "merges")
    done = _followed(first)
    if not done.where("not ends").isEmpty():
        # far along, pointers of what doesn't end all lie on cycles; those rows end, and the rest is followed again
        ring, size = done.where("not ends").select(F.col("to").alias("id")).distinct(), None
        while (now := ring.count()) != size:
            jump = done.where("not ends").select("id", "to")
            ring, size = written(ring.join(jump, "id").select(F.col("to").alias("id")).distinct(), "ring"), now
        marked = first.join(ring.withColumn("_ring", F.lit(True)), "id", "left")
        done = _followed(written(marked.select("id", F.when(F.col("_ring").isNotNull(), F.col("id")).otherwise(F.col("to")).alias("to"), (F.col("ends") | F.col("_ring").isNotNull()).alias("ends")), "merges"))
    last = identities.select(F.col("identity_id").alias("to"), F.col("cluster_id").alias("survivor"))
    ends = done.join(last, "to", "left").select(F.col("id").alias("identity_id"), "survivor")
    return identities.select("game_id", "cluster_id", "identity_id").join(ends, "identity_id").select("game_id", "cluster_id", F.coalesce("survivor", "cluster_id").alias("survivor"))


def tracklet_identity(tracklets: DataFrame, rallies: DataFrame, identities: DataFrame) -> DataFrame:
    """Tracklets with the live identity of their cluster; of dismissed ones and unknown clusters the identity is null."""
    people = identities.select("game_id", "cluster_id", F.when(~F.col("dismissed"), F.col("name")).alias("name"), F.when(~F.col("dismissed"), F.col("identity_id")).alias("identity_id"))
    return tracklets.join(rallies.select("rally_id", "game_id"), "rally_id").join(people, ["game_id", "cluster_id"], "left").select("tracklet_id", "rally_id", "game_id", "cluster_id", "identity_id", "name")


def mispaired(plays: DataFrame, tracklets: DataFrame, identities: DataFrame, rallies: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """play_id, game_id, credited, body, and `more` columns of plays: touches credited to one cluster whose linked body is of another.

    Rallies take their game's clusters along, so tracklets move by their own id alone.
    """
    clusters = identities.groupBy("game_id").agg(F.collect_set("cluster_id").alias("_clusters"))
    of = rallies.select("rally_id", "game_id").join(clusters, "game_id")
    bodies = tracklets.select("tracklet_id", "rally_id", "cluster_id").join(of, "rally_id").where(F.array_contains("_clusters", F.col("cluster_id"))).select("tracklet_id", "game_id", F.col("cluster_id").alias("body"))
    kept = plays.where("not deleted and cluster_id is not null and tracklet_id is not null").select("play_id", "tracklet_id", F.col("cluster_id").alias("credited"), *more)
    return kept.join(bodies, "tracklet_id").where("body <> credited").select("play_id", "game_id", "credited", "body", *more)


def _count(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0))


def review_state(tables: dict[str, DataFrame]) -> DataFrame:
    """Per game: rallies, scored, complete, live, corrected, unattributed, linked, removed, identities, named, mispaired."""
    of_game = tables["rallies"].select("rally_id", "game_id")
    rallies = tables["rallies"].where("phase = 'game'").groupBy("game_id").agg(F.count(F.lit(1)).alias("rallies"), F.count("outcome_type").alias("scored"), _count(F.col("touches_complete")).alias("complete"))
    kept = ~F.col("deleted")
    plays = tables["plays"].join(of_game, "rally_id").groupBy("game_id").agg(
        _count(kept).alias("live"), _count(kept & F.col("corrected")).alias("corrected"), _count(kept & F.col("cluster_id").isNull()).alias("unattributed"),
        _count(kept & F.col("tracklet_id").isNotNull()).alias("linked"), _count(F.col("deleted")).alias("removed"),
    )
    people = tables["identities"].groupBy("game_id").agg(F.count(F.lit(1)).alias("identities"), F.count("name").alias("named"))
    bad = mispaired(tables["plays"], tables["tracklets"], tables["identities"], tables["rallies"]).groupBy("game_id").agg(F.count(F.lit(1)).alias("mispaired"))
    out = tables["games"].select("game_id")
    for part in (rallies, plays, people, bad):
        out = out.join(part, "game_id", "left")
    return out.na.fill(0)


def export_corrections(tables: dict[str, DataFrame]) -> DataFrame:
    """One nested label document per rally: kept and removed touches in order, outcome and completeness.

    Touches of a rally are few; they are gathered once, sorted as structs and split by filters.
    """
    touch = F.struct("t", "play_id", "play_type", "cluster_id", "grade", "corrected", "deleted")
    plays = tables["plays"].groupBy("rally_id").agg(F.sort_array(F.collect_list(touch)).alias("all"))
    lean = lambda deleted: F.transform(F.filter("all", lambda x: x["deleted"] == deleted), lambda x: x.dropFields("deleted", "corrected"))
    rows = tables["rallies"].where("phase = 'game'").join(plays, "rally_id", "left")
    return rows.select(
        "game_id", "rally_id", "start_s", "end_s", "outcome_type", "outcome_cluster", "touches_complete", F.coalesce(lean(False), F.array()).alias("plays"), F.coalesce(lean(True), F.array()).alias("removed"),
        F.coalesce(F.size(F.filter("all", lambda x: x["corrected"] | x["deleted"])), F.lit(0)).cast("long").alias("changed"),
    )


def game_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """One nested document for each game: game_id, name, slug, played_on, video_stem, review_stats, pipeline, identities, rallies.

    rallies are all of the game in order of time, each with its outcome, completeness, kept and removed touches;
    identities keep their row ids, which merges point at. A game's rallies and identities are some dozens.
    """
    docs = export_corrections(tables | {"rallies": tables["rallies"].withColumn("_phase", F.col("phase")).withColumn("phase", F.lit("game"))})
    phases = tables["rallies"].select("rally_id", "phase")
    docs = docs.join(phases, "rally_id")
    rally = F.struct("start_s", "rally_id", "end_s", "phase", F.when(F.col("outcome_type").isNotNull(), F.struct(F.col("outcome_type").alias("type"), F.col("outcome_cluster").alias("cluster"))).alias("outcome"), "touches_complete", "plays", "removed")
    rallies = docs.groupBy("game_id").agg(
        F.sort_array(F.collect_list(rally)).alias("rallies"), F.sum("changed").alias("_changed"), F.count("outcome_type").alias("_outcomes"), F.count_if(F.col("touches_complete") & (F.col("phase") == "game")).alias("_complete")
    )
    people = tables["identities"].groupBy("game_id").agg(F.sort_array(F.collect_list(F.struct("identity_id", "cluster_id", "name", "dismissed", "merged_into"))).alias("identities"), F.count("name").alias("_named"))
    slots = resequence(tables["games"]).select("game_id", "slot")
    rows = tables["games"].join(slots, "game_id", "left").join(rallies, "game_id", "left").join(people, "game_id", "left")
    has = lambda c: F.col(c) if c in tables["games"].columns else F.lit(None).cast("string")
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(n.file_stem(has("source_file")), "name"))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    count = lambda c: F.coalesce(c, F.lit(0))
    stats = F.struct(count("_changed").alias("corrected_or_removed"), count("_outcomes").alias("outcomes_set"), count("_complete").alias("complete_rallies"), count("_named").alias("named_identities"))
    return rows.select(
        "game_id", n.display_name(F.col("label"), F.col("played_on"), F.col("slot"), F.col("name"), F.col("game_id")).alias("name"), n.game_slug(F.col("played_on"), F.col("slot"), F.col("game_id")).alias("slug"), "played_on",
        F.when(stem != "", stem).otherwise("game").alias("video_stem"), stats.alias("review_stats"), has("pipeline").alias("pipeline"), "identities", "rallies",
    )


def export_stats(documents: DataFrame, identities: DataFrame) -> DataFrame:
    """Per game: touches corrected or removed, outcomes set, complete rallies, named identities."""
    named = identities.groupBy("game_id").agg(F.count("name").alias("named"))
    stats = documents.groupBy("game_id").agg(F.sum("changed").alias("changed"), F.count("outcome_type").alias("outcomes"), _count(F.col("touches_complete")).alias("complete"))
    return stats.join(named, "game_id", "left").na.fill(0, ["named"])


#: Tables of credentials and traffic that a snapshot leaves empty, and those with an address and the id it is made of.
EMPTIED = ("sessions", "auth_tokens", "views")
ADDRESSED = {"users": "user_id", "recaps": "player_id"}


def scrub(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as a snapshot may leave: no credentials or traffic, made-up addresses, no error texts of mails, no embeddings."""
    out = {}
    for name, df in tables.items():
        if name in EMPTIED:
            df = df.where("false")
        if name in ADDRESSED:
            df = df.withColumn("email", F.concat(F.lit("user"), F.col(ADDRESSED[name]).cast("string"), F.lit("@example.invalid")))
        if name == "recaps" and "error" in df.columns:
            df = df.withColumn("error", F.lit(None).cast("string"))
        out[name] = df.drop("embedding")
    return out


def leak_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """check, rows: rows of credentials and traffic, and addresses that aren't made up, in each table that has any; all must be 0."""
    checks = {name: F.count(F.lit(1)) for name in EMPTIED} | {name: F.count_if(~F.coalesce(F.col("email").endswith("@example.invalid"), F.lit(True))) for name in ADDRESSED}
    parts = [tables[name].agg(F.lit(name).alias("check"), found.alias("rows")) for name, found in checks.items() if name in tables]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def resequence(games: DataFrame) -> DataFrame:
    """game_id, played_on, slot: place in the night by (recorded_at, undated last, game_id)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("played_on").orderBy(F.col("recorded_at").asc_nulls_last(), "game_id")
    return games.where("played_on is not null").select("game_id", "played_on", F.row_number().over(w).cast("long").alias("slot"))


def backfill_players(identities: DataFrame) -> DataFrame:
    """identity_id, name, player_id: live named identities without a player get the smallest player of that exact name, or a new key."""
    named = live_identities(identities.where("name is not null"))
    known = named.where("player_id is not null").groupBy("name").agg(F.min("player_id").alias("known"))
    rows = named.where("player_id is null").join(known, "name", "left")
    return rows.select("identity_id", "name", F.col("known").alias("player_id"), F.col("known").isNull().alias("is_new"))
