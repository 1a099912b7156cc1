"""Conversations: pairing messages, nesting turns and references, retention and invitations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import INVITATION_HOURS, INVITATIONS_PER_DAY

#: Rows of invitations still open that one task takes one after another.
AT_ONCE = 1_000_000


def exchanges(messages: DataFrame) -> DataFrame:
    """talk_id, turn_index, user_message, assistant_message: a user message and the answer right after it, if there is one."""
    at = Window.partitionBy("talk_id").orderBy("turn_index")
    after = messages.where("role in ('user', 'assistant')").withColumn("next_role", F.lead("role").over(at)).withColumn("next_text", F.lead("text").over(at))
    return after.where("role = 'user'").select("talk_id", "turn_index", F.col("text").alias("user_message"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("assistant_message"))


def turn_counts(talks: DataFrame, turns: DataFrame) -> DataFrame:
    """Every talk with its number of turns, 0 included. Counted before the join."""
    n = turns.groupBy("talk_id").agg(F.count("*").alias("turns"))
    return talks.join(n, "talk_id", "left").withColumn("turns", F.coalesce("turns", F.lit(0)))


def nested_turns(talks: DataFrame, turns: DataFrame, references: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Talks with their turns in order, each with its references, and with its model calls' tokens if usage (talk_id,
    turn_index, tokens) is given. Children are aggregated before they are joined."""
    refs = references.groupBy("talk_id", "turn_index").agg(F.sort_array(F.collect_list(F.struct("reference_index", "chunk_id", "relevance"))).alias("references"))
    rows = turns.join(refs, ["talk_id", "turn_index"], "left").withColumn("references", F.coalesce("references", F.array().cast(refs.schema["references"].dataType)))
    fields = ["turn_index", "role", "text", "references"]
    if usage is not None:
        calls = usage.groupBy("talk_id", "turn_index").agg(F.sort_array(F.collect_list("tokens")).alias("usage"))
        rows = rows.join(calls, ["talk_id", "turn_index"], "left").withColumn("usage", F.coalesce("usage", F.array().cast(calls.schema["usage"].dataType)))
        fields.append("usage")
    nested = rows.groupBy("talk_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("turns"))
    return talks.join(nested, "talk_id", "left")


def reference_rows(turns: DataFrame) -> DataFrame:
    """turns with an array `citations` of struct<index, chunk_id, relevance, score> as rows; blank ids go, the index falls
    back to the place (from 1), the relevance to the score."""
    each = turns.select("talk_id", "turn_index", F.posexplode("citations").alias("pos", "c"))
    return each.where("trim(c.chunk_id) != ''").select(
        "talk_id", "turn_index", F.coalesce("c.index", F.col("pos") + 1).alias("reference_index"), F.col("c.chunk_id").alias("chunk_id"),
        F.coalesce("c.relevance", "c.score").alias("relevance"))


def stale(talks: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return talks.where(~F.col("pinned") & (F.col("updated_at") < as_of - F.make_dt_interval(F.lit(days))))


def retain(talks: DataFrame, children: DataFrame, as_of: Column, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Talks and their children without the stale talks."""
    gone = stale(talks, as_of, days).select("talk_id")
    return talks.join(gone, "talk_id", "left_anti"), children.join(gone, "talk_id", "left_anti")


def delete_from(turns: DataFrame, talk_id, index: int) -> DataFrame:
    return turns.where((F.col("talk_id") != talk_id) | (F.col("turn_index") < index))


def to_compress(turns: DataFrame, keep: int = 2) -> DataFrame:
    """All but the last `keep` turns of talks that have more; `boundary` is the highest index among them."""
    back = F.row_number().over(Window.partitionBy("talk_id").orderBy(F.desc("turn_index")))
    old = turns.withColumn("__back", back).where(F.col("__back") > keep).drop("__back")
    return old.withColumn("boundary", F.max("turn_index").over(Window.partitionBy("talk_id")))


def set_status(talks: DataFrame, changes: DataFrame, allowed: list[str]) -> DataFrame:
    """New statuses where they are allowed; others are left, and shown in `rejected`."""
    new = changes.select("talk_id", F.col("status").alias("__new"))
    ok = F.col("__new").isin(allowed)
    return talks.join(new, "talk_id", "left").withColumn("rejected", F.col("__new").isNotNull() & ~F.coalesce(ok, F.lit(False))).withColumn(
        "status", F.when(ok, F.col("__new")).otherwise(F.col("status"))).drop("__new")


def patch(rows: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Given fields replace stored ones; null leaves a field as it is."""
    new = changes.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def invitation_states(invitations: DataFrame, as_of: Column) -> DataFrame:
    """email, state of the latest invitation: redeemed, expired or pending."""
    last = invitations.groupBy("email").agg(F.max_by(F.struct("redeemed_at", "expires_at"), F.struct("created_at", "id")).alias("x"))
    state = F.when(F.col("x.redeemed_at").isNotNull(), "redeemed").when(F.col("x.expires_at") < as_of, "expired").otherwise("pending")
    return last.select("email", state.alias("state"))


def talk_title(title: Column, message: Column) -> Column:
    """The given title up to 500 characters, else the first 120 of the message."""
    given = F.nullif(F.trim(title), F.lit(""))
    return F.when(given.isNotNull(), F.left(given, F.lit(500))).otherwise(F.left(F.trim(message), F.lit(120)))


def create_turns(talks: DataFrame, turns: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(talks, turns) after new exchanges. new: pos, talk_id, user_name, title, user_message, assistant_message.

    Exchanges of one talk are taken by pos. A talk that is not there is made, personal, with the title of its first exchange;
    one that is gets a new time. Turns are numbered on from the highest index, from 0 in a new talk.
    """
    from .ranking import first_per, next_index

    message = F.coalesce("user_message", F.lit(""))
    first = first_per(new, ["talk_id"], F.asc("pos")).select("talk_id", F.col("user_name").alias("__user"), talk_title(F.col("title"), message).alias("__title"))
    both = talks.join(first.withColumn("__new", F.lit(True)), "talk_id", "full")
    made = {"user_name": F.coalesce("user_name", "__user"), "title": F.coalesce("title", "__title"), "status": F.coalesce("status", F.lit("personal")),
            "updated_at": F.when(F.col("__new"), now).otherwise(F.col("updated_at"))}
    after = both.select(*[made[c].alias(c) if c in made else F.col(c) for c in talks.columns])
    rows = next_index(new, turns).select("talk_id", "turn_index", "user_message", "assistant_message")
    return after, turns.select("talk_id", "turn_index", "user_message", "assistant_message").unionByName(rows)


def expand_talks(hits: DataFrame, references: DataFrame, by: str = "query_id") -> DataFrame:
    """Talk hits become the chunks they refer to (themselves if there are none), distinct in order of first appearance."""
    refs = references.groupBy("talk_id").agg(F.sort_array(F.collect_list(F.struct("reference_index", "chunk_id"))).alias("refs"))
    rows = hits.join(refs, hits["chunk_id"] == refs["talk_id"], "left").withColumn("ids", F.when(
        (F.col("chunk_type") == "talk") & (F.size("refs") > 0), F.transform("refs", lambda r: r["chunk_id"])).otherwise(F.array(hits["chunk_id"])))
    each = rows.select(by, "rank", F.posexplode("ids").alias("at", "hit"))
    first = each.groupBy(by, "hit").agg(F.min(F.struct("rank", "at")).alias("place"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("place"))).select(by, "rank", F.col("hit").alias("chunk_id"))


def upsert_users(users: DataFrame, batch: DataFrame) -> DataFrame:
    """github_id, name, role: names are taken from the batch, roles are kept; new users have the role `user`."""
    new = batch.select("github_id", F.col("name").alias("__name"))
    return users.join(new, "github_id", "full").select("github_id", F.coalesce("__name", "name").alias("name"), F.coalesce("role", F.lit("user")).alias("role"))


def _in_turn(rest: DataFrame) -> DataFrame:
    """email, since: the first accepted row of each address, taken one after another in a single task. rest: pos, inviter, email, room."""

    def run(batches):
        holder, held = {}, {}  # address -> inviter, inviter -> addresses
        for b in batches:
            found = []
            for pos, inviter, email, room in zip(b["pos"].tolist(), b["inviter"], b["email"], b["room"].tolist()):
                if email in holder:
                    held[holder[email]] -= 1
                elif held.get(inviter, 0) < room:
                    found.append((email, pos))
                else:
                    continue
                holder[email] = inviter
                held[inviter] = held.get(inviter, 0) + 1
            yield pd.DataFrame(found, columns=["email", "since"])

    schema = T.StructType([rest.schema["email"], T.StructField("since", rest.schema["pos"].dataType)])
    return rest.select("pos", "inviter", "email", "room").repartition(1).sortWithinPartitions("pos").mapInPandas(run, schema)


def create_invitations(invitations: DataFrame, new: DataFrame, now: Column, per_day: int = INVITATIONS_PER_DAY, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(invitations after new ones, new with `accepted`). new: pos, inviter, email, code, taken one after another by pos.

    An address that has a pending invitation, stored or accepted before, is invited again: the earlier one goes, and no
    place of the day is needed. Any other is refused to inviters who have `per_day` rows of the last 24 hours, those
    accepted before among them and those replaced before not. So an address is known from its first accepted row on, and
    an address that is known earlier only adds to counts: rounds that judge all rows by the last round's first rows give
    bounds from both sides in turn, and what two rounds agree on is the sequential result. Once at most `at_once` rows
    belong to addresses that are still open, these are taken one after another; until then there are further rounds.
    """
    from ..sources.scratch import written

    asked = new.withColumn("email", F.lower(F.trim("email")))
    pending = invitations.where("status = 'pending'").groupBy("email").agg(F.lit(True).alias("__pending"))
    recent = (F.col("created_at") >= now - F.expr("interval 24 hours")) & (F.col("created_at") <= now)
    sent = invitations.where(recent).groupBy("inviter").agg(F.count("*").alias("__sent"))
    lost = invitations.where((F.col("status") == "pending") & recent).groupBy("email", "inviter").agg((-F.count("*")).alias("delta"))
    rows = written(asked.join(pending, "email", "left").join(sent, "inviter", "left").select(
        "pos", "inviter", "email", "code", F.coalesce("__pending", F.lit(False)).alias("__pending"), (per_day - F.coalesce("__sent", F.lit(0))).alias("__left")), "invited")
    lost = written(lost, "lost")
    by_email, by_inviter = Window.partitionBy("email").orderBy("pos"), Window.partitionBy("inviter").orderBy("pos")

    def with_room(judged: DataFrame, since: DataFrame) -> DataFrame:
        """judged with `room`: places that are left to the inviter before the row, if addresses are known from `since` on."""
        taken = rows.join(since, "email").where("pos >= since").select("email", "inviter", "pos").withColumn("before", F.lag("inviter").over(by_email))
        gone = taken.where("before is not null").select(F.col("before").alias("inviter"), "pos", F.lit(-1).alias("delta"))  # replaced within the batch
        first = since.where("since is not null").join(lost, "email").select("inviter", F.col("since").alias("pos"), "delta")
        events = taken.select("inviter", "pos", F.lit(1).alias("delta")).union(gone).union(first).groupBy("inviter", "pos").agg(F.sum("delta").alias("delta"))
        both = judged.select("inviter", "pos", "email", "__pending", "__left", F.lit(0).alias("delta")).unionByName(events, allowMissingColumns=True)
        earlier = F.coalesce(F.sum("delta").over(by_inviter.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return both.withColumn("room", F.col("__left") - earlier).where("email is not null").drop("delta")

    since = rows.groupBy("email").agg(F.min("pos").alias("since"))
    while True:
        fits = with_room(rows, since).groupBy("email").agg(F.min(F.when(F.col("__pending") | (F.col("room") > 0), F.col("pos"))).alias("next"))
        judged = written(since.join(fits, "email"), "since")
        opened = judged.where("not (since <=> next)").select("email")
        rest = rows.join(opened, "email", "left_semi")
        n = rest.limit(at_once + 1).count()
        if 0 < n <= at_once:
            settled = judged.where("since <=> next").select("email", "since")
            since = written(settled.unionByName(_in_turn(with_room(rest, settled))), "since")
            break
        since = judged.select("email", F.col("next").alias("since"))
        if not n:
            break
    rows = rows.join(since, "email", "left").withColumn("accepted", F.coalesce(F.col("pos") >= F.col("since"), F.lit(False)))
    last = rows.where("accepted").groupBy("email").agg(F.max_by(F.struct("inviter", "code"), "pos").alias("x"))
    made = last.select(F.lit(None).cast(invitations.schema["id"].dataType).alias("id"), "x.inviter", "email", "x.code", F.lit("pending").alias("status"), now.alias("created_at"))
    kept = invitations.where("status != 'pending'").unionByName(invitations.where("status = 'pending'").join(last.select("email"), "email", "left_anti"))
    return kept.unionByName(made), rows.select("pos", "inviter", "email", "code", "accepted")


def redeem_invitations(invitations: DataFrame, tries: DataFrame, now: Column, hours: int = INVITATION_HOURS) -> DataFrame:
    """pos, email, code, outcome of each try, taken by pos: redeemed for the first one with a pending code that has not
    expired, else expired where such a code has, else invalid."""
    fresh = F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(hours)) > now
    known = invitations.groupBy("email", "code").agg(F.max((F.col("status") == "pending") & fresh).alias("__open"), F.max(~fresh).alias("__old"))
    rows = tries.withColumn("email", F.lower(F.trim("email"))).withColumn("__try", F.row_number().over(Window.partitionBy("email", "code").orderBy("pos"))).join(known, ["email", "code"], "left")
    outcome = F.when(F.col("__open") & (F.col("__try") == 1), "redeemed").when(F.col("__old"), "expired").otherwise("invalid")
    return rows.select("pos", "email", "code", outcome.alias("outcome"))


def recode(column: Column, names: dict[str, str]) -> Column:
    """Old names become new ones, others stay."""
    out = column
    for old, new in names.items():
        out = F.when(column == old, new).otherwise(out)
    return out
