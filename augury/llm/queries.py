"""The queries of the corpus operators, each over its whole table, and their DuckDB texts where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from augury.llm import ann, bpe, collocation, egojoin, jaccard, langid, lm, mixing, packing, periodic, pii, quality, suffix
from augury.llm.common import WORD, in_fold, table, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op6_bpe")
def op6_bpe(spark, sf):
    """Ids of every text and the text they decode to, as digests."""
    coded = bpe.encode(table(spark, sf, "documents"), keep=("doc_id",), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query(
    "op7_mixing",
    r"""
    with rows as (
      select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
    ), counted as (
      select doc_id, source, size, count(*)::bigint as n_rows from rows group by all
    ), units as (
      select *, size * n_rows as x, length(bin(size + 2))::bigint as v,
             (('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '?') || '|' || coalesce(source, '?')), 1, 13))::bigint::double + 0.5)
               / 4503599627370496.0::double as u
      from counted
    ), sources as (
      select source, sum(x)::bigint as source_size, sum(x * v)::bigint as vx,
             row_number() over (order by source nulls last) as place
      from units group by source
    ), weighed as (
      select *, [5, 2, 1][(place - 1) % 3 + 1]::bigint as w, source_size * 2 as cap from sources
    ), filled as (
      select *, cap::double / w::double as level,
             sum(cap) over o as caps, sum(w) over o as weights, sum(source_size) over () as total, sum(w) over () as ws
      from weighed window o as (order by cap::double / w::double, place)
    ), opened as (
      select arg_min(((1.5::double * total::double) - (caps - cap)::double) / (ws - (weights - w))::double, place_in) as open_level
      from (select *, row_number() over (order by level, place) as place_in from filled)
      where ((1.5::double * total::double) - (caps - cap)::double) / (ws - (weights - w))::double <= level
    ), targets as (
      select source, source_size, vx, least(cap::double, open_level * w::double) as target from weighed, opened
    ), wanted as (
      select u.*, t.source_size, t.target, least(2.0::double, coalesce(t.target * u.v::double / nullif(t.vx, 0)::double, 0)) as wanted
      from units u join targets t on u.source is not distinct from t.source
    ), parts as (
      select *, floor(wanted)::bigint as whole, wanted - floor(wanted) as p from wanted
    ), rest as (
      select *, target - (sum(whole * x) over s)::double as left_over, sum(case when whole < 2 then x else 0 end) over s as room
      from parts window s as (partition by source)
    ), means as (
      select *, least(0.999999::double, greatest(0.000001::double, coalesce(left_over / nullif(room, 0)::double, 0))) as mean from rest
    ), ranks as (
      select *, case when whole >= 2 then 2 when p <= 0 then 1
                     else u * (1 - p) * mean / (u * (1 - p) * mean + p * (1 - u) * (1 - mean)) end as rank_
      from means
    ), sums as (
      select *, coalesce(sum(x) over (partition by source order by rank_, u, doc_id nulls first, size
                                      rows between unbounded preceding and 1 preceding), 0) as before
      from ranks
    )
    select doc_id, size, source_size, target,
           (size * (whole + case when whole < 2 and 2 * before + x <= 2 * left_over then 1 else 0 end))::bigint as taken,
           source, (whole + case when whole < 2 and 2 * before + x <= 2 * left_over then 1 else 0 end)::bigint as copies
    from sums, unnest(range(n_rows)) as again(k)
    """,
)
def op7_mixing(spark, sf):
    """How often the mix takes each document, with importance by length."""
    decided = mixing.mix(table(spark, sf, "documents"), importance=mixing.length_importance())
    each = decided.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


@query("op10_langid")
def op10_langid(spark, sf):
    """The language of every text, learnt from the other folds."""
    docs = table(spark, sf, "documents")
    model = langid.learn(docs.where(~in_fold("doc_id", 3, 1)))
    found = langid.identify(docs, model)
    return found.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "n_letters", "langs")


@query("op5_pii")
def op5_pii(spark, sf):
    """Spans of personal data in every text."""
    docs = table(spark, sf, "documents")
    found = pii.tag(docs, pii.learn(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.encode(pii.joined("spans", True), "UTF-8"), 256).alias("base_sha256"),
        pii.joined("spans", False).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


@query("op8_jaccard")
def op8_jaccard(spark, sf):
    """The class of near-duplicates of every document and how many documents it links with."""
    return jaccard.classes(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_egojoin")
def op4_egojoin(spark, sf):
    """Links and component of every vector."""
    found = egojoin.links(table(spark, sf, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))


@query(
    "op9_ann",
    """
    with usable as (
      select vec_id, embedding::double[] as v from embeddings
      where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), scored as (
      select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
      from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
    ), placed as (
      select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
    )
    select query_id, rank, vec_id, score from placed where rank <= 20
    """,
)
def op9_ann(spark, sf):
    """The 20 nearest vectors of every 20th vector."""
    return ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op1_quality")
def op1_quality(spark, sf):
    """Quality of every document; ``keep`` where good quality is the likelier."""
    docs = table(spark, sf, "documents")
    found = quality.score(docs, quality.learn(docs, table(spark, sf, "labels")))
    return found.select("doc_id", "quality", (F.col("quality") >= 0.5).alias("keep"), "content_score", "metadata_score")


@query("op3_lm")
def op3_lm(spark, sf):
    """Base score and attention model score of every text."""
    found = lm.score(table(spark, sf, "documents"), in_fold("doc_id", 7, 2))
    return found.withColumnRenamed("id", "doc_id")


@query("op2_suffix")
def op2_suffix(spark, sf):
    """What remains of every text without the 200-byte strings that occur more than once."""
    found = suffix.dedup(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, p: s + p["end"] - p["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op11_collocation",
    r"""
    with pieces as (
      select coalesce(lang, 'und') as lang,
             unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
      from documents
    ), split as (
      select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') as w from pieces
    ), grams as (
      select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) as phrase
      from split, (values (1), (2), (3)) as sizes(k)
    ), counted as (
      select lang, k, phrase, count(*)::hugeint as f from grams group by all
    ), totals as (
      select lang, sum(f)::bigint as n from counted where k = 1 group by 1
    ), cuts as (
      select lang, phrase, k, f as a, cut, array_to_string(list_slice(string_split(phrase, ' '), 1, cut), ' ') as left_part,
             array_to_string(list_slice(string_split(phrase, ' '), cut + 1, k), ' ') as right_part
      from counted, (values (1), (2)) as cuts(cut) where k >= 2 and f >= 10 and cut < k
    ), rated as (
      select c.lang, c.phrase, c.k, c.a, c.cut, x.f as l, y.f as r, (1000000::hugeint * c.a * c.a) // (x.f * y.f) as score
      from cuts c join counted x on x.lang = c.lang and x.phrase = c.left_part join counted y on y.lang = c.lang and y.phrase = c.right_part
    ), scored as (
      select * from rated qualify row_number() over (partition by lang, phrase order by score, cut) = 1
    ), around as (
      select lang, unnest([array_to_string(list_slice(string_split(phrase, ' '), 1, 2), ' '), array_to_string(list_slice(string_split(phrase, ' '), 2, 3), ' ')]) as phrase, f
      from counted where k = 3 and f >= 10
    ), held as (
      select lang, phrase, max(f) as f from around group by all
    ), kept as (
      select s.* from scored s left join held h on h.lang = s.lang and h.phrase = s.phrase where h.f is null or 100 * h.f < 50 * s.a
    ), placed as (
      select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
    )
    select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from placed join totals using (lang) where rank <= 2000
    """,
)
def op11_collocation(spark, sf):
    """The 2,000 best phrases of two and three words of every language."""
    return collocation.mine(table(spark, sf, "documents"))


def _with_repeats(docs):
    """``doc_id`` and ``text``, in a tenth of the documents with the words from a place chosen by the id on repeated to the end."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.regexp_extract_all(text_or_empty("text"), F.lit(f"({WORD})"), F.lit(0))
    some = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    some = some.withColumns({"n": F.size("w"), "g": F.expr("h div 10")})
    some = some.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    # Whole periods, as many as cover the rest: no lambda, so that the words are taken from the text once.
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return some.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), made).otherwise(F.col("text")).alias("text"))


@query(
    "op12_periodic",
    r"""
    with hashed as (
      select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
             xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, len(doc_id::varchar) + 1),
               lambda k: list_transform(range(0, 8), lambda j: (ascii(substr(doc_id::varchar, k::int, 1)) >> j::int) & 1)))::bigint[]),
               lambda c, b: xor(c >> 1, 3988292384::bigint * (xor(c, b) & 1))), 4294967295::bigint) as h
      from documents
    ), placed as (
      select doc_id, w, h, len(w) as n, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) end as a from hashed
    ), made as (
      select doc_id, n, case when h % 10 = 0 and n > 0
        then list_concat(list_slice(w, 1, a), list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1])) else w end as w
      from placed
    ), grams as (
      select doc_id, i, g[i + 1] as gram
      from (select doc_id, n, list_transform(range(0, n - 15), lambda i: array_to_string(list_slice(w, i + 1, i + 16), ' ')) as g from made) t, unnest(range(0, n - 15)) as u(i)
      where n >= 24
    ), pairs as (
      select x.doc_id, x.i, y.i - x.i as q from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and x.i < y.i
    ), islands as (
      select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs
    ), stretches as (
      select doc_id, q, min(i) as s, count(*) + 15 + q as length from islands group by doc_id, q, island
    ), runs as (
      select * from stretches where length >= 24 and length >= 3 * q qualify q = min(q) over (partition by doc_id, s, length)
    ), listed as (
      select doc_id, count(*) as n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as lines from runs group by 1
    ), best as (
      select r.* from runs r anti join runs o on o.doc_id = r.doc_id
        and (o.length * r.q > r.length * o.q or (o.length * r.q = r.length * o.q and (o.s < r.s or (o.s = r.s and o.q < r.q))))
    ), dropped as (
      select distinct doc_id, unnest(range(s + q, s + length)) as i from runs
    ), words as (
      select m.doc_id, i, m.w[i + 1] as word from made m, unnest(range(0, m.n)) as u(i)
    ), collapsed as (
      select doc_id, string_agg(word, ' ' order by i) as kept from words anti join dropped using (doc_id, i) group by 1
    )
    select m.doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.s::bigint as start, b.length::bigint as length, b.q::bigint as period,
           (1000 * b.length // b.q)::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
    from made m left join listed l using (doc_id) left join best b using (doc_id) left join collapsed c using (doc_id)
    """,
)
def op12_periodic(spark, sf):
    """Runs of repeated words in every text, and what is left of it without the repeats."""
    found = periodic.runs(_with_repeats(table(spark, sf, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(F.transform("runs", line), "\n"), F.lit("\n"))).otherwise("")
    longer = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    found = found.withColumn("_best", F.aggregate("runs", F.lit(None).cast(periodic.RUN), longer))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


@query("op13_packing")
def op13_packing(spark, sf):
    """The place of every piece of every document in sequences of 2,048 tokens."""
    return packing.pack(table(spark, sf, "documents"))
