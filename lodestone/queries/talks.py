"""Queries over conversations and what is derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, ranking
from ..operators import talks as T
from ..registry import query
from ..schemas import TALK_STATUSES
from ..sources.testdata import TURNS_SQL, table, turns

_TALKS = """talks as (select talk_id, ['draft', 'published', 'personal', 'bug'][talk_id % 4 + 1] as status, talk_id % 5 = 0 as pinned, 'main' as collection, 'Talk ' || talk_id as title,
  'user' || (talk_id % 7) as user_name, case when talk_id % 3 = 0 then 'p-' || talk_id % 6 end as paragraph_id, 'About ' || talk_id % 13 as summary,
  timestamp '2024-01-01' + to_minutes(talk_id * 300) as updated_at from (select distinct conv_id as talk_id from conversations))"""
_REFS = """refs as (select talk_id, turn_index, 1 as reference_index, 'doc-' || (talk_id * 10 + turn_index) as chunk_id, 0.5::double as relevance from turns where role = 'assistant'
  union all select talk_id, turn_index, 2, 'doc-' || (talk_id + turn_index), 0.25 from turns where role = 'assistant' and talk_id % 2 = 0)"""
T_ = f"with {TURNS_SQL}, {_TALKS}, {_REFS} "


def talks(spark, d):
    t = F.col("talk_id")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("talk_id")).distinct().select(
        "talk_id", F.element_at(F.array(*[F.lit(s) for s in TALK_STATUSES]), (t % 4 + 1).cast("int")).alias("status"), (t % 5 == 0).alias("pinned"), F.lit("main").alias("collection"),
        F.concat(F.lit("Talk "), t).alias("title"), F.concat(F.lit("user"), t % 7).alias("user_name"), F.when(t % 3 == 0, F.concat(F.lit("p-"), t % 6)).alias("paragraph_id"),
        F.concat(F.lit("About "), t % 13).alias("summary"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(talk_id * 300 as int), 0)").alias("updated_at"))


def references(spark, d):
    one = F.struct(F.lit(None).cast("int").alias("index"), F.concat(F.lit("doc-"), F.col("talk_id") * 10 + F.col("turn_index")).alias("chunk_id"), F.lit(0.5).alias("relevance"), F.lit(0.9).alias("score"))
    two = F.struct(F.lit(2).alias("index"), F.concat(F.lit("doc-"), F.col("talk_id") + F.col("turn_index")).alias("chunk_id"), F.lit(None).cast("double").alias("relevance"), F.lit(0.25).alias("score"))
    answers = turns(spark, d).where("role = 'assistant'")
    return T.reference_rows(answers.withColumn("citations", F.when(F.col("talk_id") % 2 == 0, F.array(one, two)).otherwise(F.array(one))))


@query(T_ + "select talk_id, turn_index, reference_index, chunk_id, relevance from refs")
def reference_payload(spark, d):
    return references(spark, d)


@query(T_ + """, x as (select *, lead(role) over w as nr, lead(text) over w as nt from turns where role in ('user', 'assistant') window w as (partition by talk_id order by turn_index))
  select talk_id, turn_index, text as user_message, case when nr = 'assistant' then nt end as assistant_message from x where role = 'user'""")
def turn_pairs(spark, d):
    return T.exchanges(turns(spark, d))


@query(T_ + "select talk_id, status, (select count(*) from turns u where u.talk_id = t.talk_id and u.role = 'assistant' and u.turn_index > 1) as turns from talks t")
def talk_turn_counts(spark, d):
    return T.turn_counts(talks(spark, d).select("talk_id", "status"), turns(spark, d).where("role = 'assistant' and turn_index > 1"))


@query(T_ + """, r as (select talk_id, turn_index, string_agg(reference_index || ':' || chunk_id, ' ' order by reference_index) as rs from refs group by 1, 2)
  select t.talk_id, string_agg(u.turn_index || ' ' || role || ' ' || length(coalesce(text, '')) || ' [' || coalesce(rs, '') || ']', ';' order by u.turn_index) as turns
  from talks t left join turns u on u.talk_id = t.talk_id left join r on r.talk_id = u.talk_id and r.turn_index = u.turn_index where status = 'published' group by 1""")
def talk_nested_turns(spark, d):
    nested = T.nested_turns(talks(spark, d).where("status = 'published'").select("talk_id"), turns(spark, d), references(spark, d))
    refs = lambda t: F.array_join(F.transform(t["references"], lambda r: F.concat(r["reference_index"].cast("string"), F.lit(":"), r["chunk_id"])), " ")
    line = lambda t: F.concat(t["turn_index"].cast("string"), F.lit(" "), t["role"], F.lit(" "), F.length(F.coalesce(t["text"], F.lit(""))).cast("string"), F.lit(" ["), refs(t), F.lit("]"))
    return nested.select("talk_id", F.array_join(F.transform("turns", line), ";").alias("turns"))


@query(T_ + "select talk_id, turn_index from turns qualify row_number() over (partition by talk_id order by turn_index desc) <= 8")
def last_n_turns(spark, d):
    return ranking.last_per(turns(spark, d), "talk_id", "turn_index", 8).select("talk_id", "turn_index")


@query(T_ + ", n as (select talk_id, unnest(range(0, 2)) as pos from talks) select n.talk_id, pos, coalesce((select max(turn_index) from turns u where u.talk_id = n.talk_id and u.talk_id % 3 > 0) + 1 + pos, pos)::bigint as turn_index from n")
def next_turn_index(spark, d):
    new = talks(spark, d).select("talk_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("pos"))
    return ranking.next_index(new, turns(spark, d).where("talk_id % 3 > 0")).select("talk_id", "pos", "turn_index")


@query(T_ + "select talk_id from talks where paragraph_id is null and pinned and (title ilike '%1%' or summary ilike '%1%') order by pinned desc, updated_at desc, talk_id limit 100")
def talk_search(spark, d):
    found = talks(spark, d).where(filters.talk_search(None, True, "1"))
    return found.orderBy(F.desc("pinned"), F.desc("updated_at"), "talk_id").select("talk_id").limit(100)


@query(T_ + "select talk_id from talks where paragraph_id = 'p-3' and (title ilike '%7%' or summary ilike '%7%')")
def talk_search_by_paragraph(spark, d):
    return talks(spark, d).where(filters.talk_search("p-3", True, "7")).select("talk_id")


@query(T_ + "select talk_id, count(*) over () as total from talks where collection = 'main' and status in ('draft', 'bug') and (title ilike '%1%' or user_name ilike '%1%') order by updated_at desc, talk_id limit 10 offset 5")
def talk_listing_page(spark, d):
    found = talks(spark, d).where(filters.talks("main", "draft, bug", "1"))
    page = found.orderBy(F.desc("updated_at"), "talk_id").offset(5).limit(10)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total")))).select("talk_id", "total")  # one row


@query(T_ + ", gone as (select talk_id from talks where not pinned and updated_at < timestamp '2024-01-15' - interval 7 days) select talk_id, turn_index from turns where talk_id not in (from gone)")
def talk_retention(spark, d):
    return T.retain(talks(spark, d), turns(spark, d), F.expr("timestamp_ntz'2024-01-15 00:00:00'"))[1].select("talk_id", "turn_index")


@query(T_ + "select talk_id, turn_index from turns where talk_id <> 3 or turn_index < 2")
def delete_turns_from(spark, d):
    return T.delete_from(turns(spark, d), 3, 2).select("talk_id", "turn_index")


@query(T_ + """, o as (select * from turns qualify row_number() over (partition by talk_id order by turn_index desc) > 2) select talk_id, turn_index, max(turn_index) over (partition by talk_id) as boundary from o""")
def compress_window(spark, d):
    return T.to_compress(turns(spark, d)).select("talk_id", "turn_index", "boundary")


@query(T_ + "select talk_id, case when talk_id % 3 = 1 then 'published' else status end as status, talk_id % 3 = 2 as rejected from talks")
def status_transition(spark, d):
    t = talks(spark, d)
    changes = t.where("talk_id % 3 > 0").select("talk_id", F.when(F.col("talk_id") % 3 == 1, "published").otherwise("gone").alias("status"))
    return T.set_status(t, changes, TALK_STATUSES).select("talk_id", "status", "rejected")


@query(T_ + "select talk_id, case when talk_id % 2 = 0 then 'New ' || talk_id else title end as title, case when talk_id % 2 = 1 then true else pinned end as pinned from talks")
def settings_patch(spark, d):
    t = talks(spark, d)
    even = F.col("talk_id") % 2 == 0
    changes = t.select("talk_id", F.when(even, F.concat(F.lit("New "), "talk_id")).alias("title"), F.when(~even, F.lit(True)).alias("pinned"))
    return T.patch(t, changes, "talk_id", ["title", "pinned"]).select("talk_id", "title", "pinned")


@query("""with i as (select event_id as id, 'u' || user_id as email, ts as created_at, ts + interval 48 hours as expires_at, case when event_type = 'purchase' then ts end as redeemed_at from events)
  select email, case when redeemed_at is not null then 'redeemed' when expires_at < timestamp '2024-01-31' then 'expired' else 'pending' end as state from i qualify row_number() over (partition by email order by created_at desc, id desc) = 1""")
def invitation_states(spark, d):
    i = table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("email"), F.col("ts").alias("created_at"),
                                         (F.col("ts") + F.expr("interval 48 hours")).alias("expires_at"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("redeemed_at"))
    return T.invitation_states(i, F.expr("timestamp_ntz'2024-01-31 00:00:00'"))


@query(T_ + "select talk_id, turn_index, case when turn_index = 0 then left('T ' || talk_id, 500) else left(trim(coalesce(text, '')), 120) end as title from turns where role = 'user'")
def talk_titles(spark, d):
    t = turns(spark, d).where("role = 'user'")
    return t.select("talk_id", "turn_index", T.talk_title(F.when(F.col("turn_index") == 0, F.concat(F.lit("T "), "talk_id")).otherwise(F.lit("  ")), F.coalesce("text", F.lit(""))).alias("title"))


@query(T_ + """, h as (select talk_id // 50 as query_id, talk_id, case when talk_id % 4 = 3 then 'book' else 'talk' end as kind, talk_id as rank from talks),
  e as (select query_id, rank, coalesce(turn_index, 0) as a, coalesce(reference_index, 0) as b, case when kind = 'talk' and r.chunk_id is not null then r.chunk_id else 'talk-' || h.talk_id end as hit from h left join (select * from refs where turn_index = 2) r on r.talk_id = h.talk_id),
  f as (select query_id, hit, min(rank * 1000 + b) as place from e group by all) select query_id, row_number() over (partition by query_id order by place) as rank, hit as chunk_id from f""")
def talk_reference_expansion(spark, d):
    """Hits on talks become the chunks that their third turn cites."""
    name = lambda c: F.concat(F.lit("talk-"), c)
    hits = talks(spark, d).select(F.expr("talk_id div 50").alias("query_id"), name("talk_id").alias("chunk_id"), F.when(F.col("talk_id") % 4 == 3, "book").otherwise("talk").alias("chunk_type"), F.col("talk_id").alias("rank"))
    refs = references(spark, d).where("turn_index = 2").withColumn("talk_id", name("talk_id"))
    return T.expand_talks(hits, refs).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


@query(T_ + """, r as (select talk_id, turn_index, count(*) as n from refs group by 1, 2), g as (select talk_id, turn_index, sum(turn_index * 10 + k)::bigint as tokens from turns, (values (0), (1)) t(k) where k = 0 or turn_index % 2 = 0 group by 1, 2)
  select t.talk_id, string_agg(u.turn_index || ':' || coalesce(r.n, 0) || ':' || g.tokens, ' ' order by u.turn_index) as turns from talks t join turns u on u.talk_id = t.talk_id
  left join r on r.talk_id = u.talk_id and r.turn_index = u.turn_index join g on g.talk_id = u.talk_id and g.turn_index = u.turn_index group by 1""")
def talk_detail(spark, d):
    """Turns with their references and their model calls: both are gathered before they meet, so neither multiplies the other."""
    calls = turns(spark, d).select("talk_id", "turn_index", F.explode(F.when(F.col("turn_index") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("k"))
    usage = calls.select("talk_id", "turn_index", (F.col("turn_index") * 10 + F.col("k")).alias("tokens"))
    nested = T.nested_turns(talks(spark, d).select("talk_id"), turns(spark, d), references(spark, d), usage)
    line = lambda t: F.concat_ws(":", t["turn_index"].cast("string"), F.size(t["references"]).cast("string"), F.aggregate(t["usage"], F.lit(0).cast("long"), lambda a, x: a + x).cast("string"))
    return nested.where("turns is not null").select("talk_id", F.array_join(F.transform("turns", line), " ").alias("turns"))


@query(T_ + """select 'messages' as kind, talk_id, turn_index from turns qualify row_number() over (partition by talk_id order by turn_index desc) <= 6
  union all select 'asked', talk_id, turn_index from turns where role = 'user' qualify row_number() over (partition by talk_id order by turn_index desc) <= 3""")
def recent_messages(spark, d):
    """The last six messages of a talk, and the user's last three."""
    t = turns(spark, d).select("talk_id", "turn_index", "role")
    six, three = ranking.last_per(t, "talk_id", "turn_index", 6), ranking.last_per(t.where("role = 'user'"), "talk_id", "turn_index", 3)
    return six.select(F.lit("messages").alias("kind"), "talk_id", "turn_index").union(three.select(F.lit("asked"), "talk_id", "turn_index"))


@query(T_ + """, e as (select 'e' || (talk_id % 30) as email, talk_id from talks), i as (select email, max(talk_id) as last from e where talk_id % 30 < 20 group by 1)
  select distinct e.email, case when i.email is null then 'none' when last % 3 = 0 then 'redeemed' when last % 3 = 1 then 'expired' else 'pending' end as state from e left join i using (email)""")
def invitation_state_of_addresses(spark, d):
    """Every address, also those without an invitation."""
    t = talks(spark, d).select(F.concat(F.lit("e"), F.col("talk_id") % 30).alias("email"), "talk_id")
    now = F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    sent = t.where("talk_id % 30 < 20").select(
        "email", F.col("talk_id").alias("id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(talk_id as int), 0, 0)").alias("created_at"),
        F.when(F.col("talk_id") % 3 == 0, now).alias("redeemed_at"), F.when(F.col("talk_id") % 3 == 1, F.expr("timestamp_ntz'2024-01-20 00:00:00'")).otherwise(F.expr("timestamp_ntz'2024-03-01 00:00:00'")).alias("expires_at"))
    states = T.invitation_states(sent, now)
    return t.select("email").distinct().join(states, "email", "left").select("email", F.coalesce("state", F.lit("none")).alias("state"))


@query("""with t as (select conv_id as talk_id, sum(length(coalesce(text, '')) // 4)::bigint as turns from conversations group by 1), c as (select doc_id // 10 as talk_id, sum(length(coalesce(text, '')) // 4)::bigint as cited from documents where doc_id % 2 = 0 group by 1),
  x as (select talk_id, turns, coalesce(cited, 0) as cited, case when talk_id % 3 = 0 then length('document ' || talk_id) // 4 else 0 end as document, case when talk_id % 2 = 0 then length('paragraph ' || talk_id) // 4 else 0 end as paragraph from t left join c using (talk_id))
  select talk_id, turns, cited, turns + cited + document + paragraph + 800 as tokens from x""")
def context_tokens(spark, d):
    """All parts of a talk's context: turns, cited texts, document, paragraph and the system prompt."""
    from ..functions.text import tokens_estimate

    t = turns(spark, d).groupBy("talk_id").agg(F.sum(tokens_estimate(F.col("text"))).alias("turns"))
    c = table(spark, d, "documents").where("doc_id % 2 = 0").groupBy(F.expr("doc_id div 10").alias("talk_id")).agg(F.sum(tokens_estimate(F.col("text"))).alias("cited"))
    i = F.col("talk_id")
    parts = [F.when(i % n == 0, F.concat(F.lit(name), i)) for n, name in ((3, "document "), (2, "paragraph "))]
    rows = t.join(c, "talk_id", "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    return rows.select("talk_id", "turns", "cited", (F.col("turns") + F.col("cited") + sum((tokens_estimate(p) for p in parts), F.lit(800))).alias("tokens"))


@query("""with talks as (select conv_id as talk_id, 'user' || conv_id % 7 as user_name, 'Talk ' || conv_id as title, 'draft' as status, timestamp '2024-01-01' as updated_at from (select distinct conv_id from conversations) where conv_id % 3 > 0),
  old as (select conv_id as talk_id, turn as turn_index from conversations where conv_id % 3 > 0 and role = 'user'), new as (select conv_id as talk_id, turn as pos, 'user' || conv_id % 5 as user_name, case when conv_id % 2 = 0 then 'Title ' || turn end as title, coalesce(text, '') as message from conversations where role = 'user' and conv_id % 4 > 0),
  n as (select new.*, row_number() over (partition by talk_id order by pos) as k from new), t as (select talk_id, max(turn_index) as top from old group by 1),
  x as (select coalesce(talks.talk_id, n.talk_id) as talk_id, coalesce(talks.user_name, n.user_name) as user_name, coalesce(talks.title, n.title, left(trim(n.message), 120)) as title, coalesce(status, 'personal') as status, case when n.talk_id is not null then timestamp '2025-01-01' else updated_at end as updated_at from talks full join (from n where k = 1) n on n.talk_id = talks.talk_id),
  all_turns as (select talk_id, turn_index from old union all select n.talk_id, coalesce(top + k, k - 1) from n left join t on t.talk_id = n.talk_id)
  select x.*, u.turns, u.last from x left join (select talk_id, count(*) as turns, max(turn_index)::bigint as last from all_turns group by 1) u on u.talk_id = x.talk_id""")
def create_talk_turns(spark, d):
    """Exchanges go on in talks that are there, and make those that are not, with their first title or message."""
    i, rows = F.col("conv_id"), table(spark, d, "conversations")
    stored = rows.where("conv_id % 3 > 0")
    known = stored.select("conv_id").distinct().select(i.alias("talk_id"), F.concat(F.lit("user"), i % 7).alias("user_name"), F.concat(F.lit("Talk "), i).alias("title"), F.lit("draft").alias("status"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("updated_at"))
    old = stored.where("role = 'user'").select(i.alias("talk_id"), F.col("turn").alias("turn_index"), F.col("text").alias("user_message"), F.lit("").alias("assistant_message"))
    new = rows.where("role = 'user' and conv_id % 4 > 0").select(
        i.alias("talk_id"), F.col("turn").alias("pos"), F.concat(F.lit("user"), i % 5).alias("user_name"), F.when(i % 2 == 0, F.concat(F.lit("Title "), "turn")).alias("title"), F.col("text").alias("user_message"), F.lit("answer").alias("assistant_message"))
    after, every = T.create_turns(known, old, new, F.expr("timestamp_ntz'2025-01-01 00:00:00'"))
    return after.join(every.groupBy("talk_id").agg(F.count("*").alias("turns"), F.max("turn_index").alias("last")), "talk_id", "left")
