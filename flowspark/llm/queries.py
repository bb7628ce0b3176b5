"""The queries ``op1`` to ``op13`` and the SQL that checks them."""

import zlib
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import (
    bpe, jaccard, line_dedup, packing, periodic_runs, quality_classifier, quality_rules, sharding, spelling, suffix_dedup, topk,
    url_filter, warc,
)
from flowspark.llm.tables import table

QUERIES = {}
CHECKS = {}


def _query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            CHECKS[build.__name__] = sql
        return build

    return register


@_query(r"""
with d as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) x from pages),
g as (select x, max(page_id) winner from d group by x)
select page_id, cast(payload_bytes as bigint) payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
    (cast('0x' || substr(x, 1 + 10 * (i // 8), 10) as bigint) >> cast(35 - 5 * (i % 8) as bigint)) & 31 as int), 1)), '')
    payload_digest,
  case when winner <> page_id then 'revisit' else 'response' end record_type,
  case when winner <> page_id then winner end refers_to
from d join g using (x)
""")
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to archives and read back from them."""
    pages = table(spark, folder, "pages", ["page_id", "url", "html"])
    rows = warc.archive_round_trip(pages, "page_id", "url", "html")
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "path", "offset", "problem")))

    def page(column: str):
        return F.expr(f"try_cast(substring_index({column}, ':', -1) as bigint)")

    return rows.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        checked.otherwise(F.col("record_type")).alias("record_type"), page("refers_to_id").alias("refers_to"))


@_query("""
with n as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) v, row_number() over () n
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
e as (select vec_id, n, list_resize(v, (select greatest(max(len(v)), 1) from n), 0.0) v from n),
s as (select q.n, q.vec_id query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) score
  from e q join e c on q.vec_id % 20 = 0 and c.n <> q.n),
r as (select *, cast(row_number() over (partition by n order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
""")
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best of all vectors for every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, folder, "embeddings", ["vec_id", "embedding"]), "vec_id", "embedding", "id % 20 = 0")


@_query(r"""
with u as (select page_id, coalesce(url, '') url from pages),
r as (select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from u),
h as (select *, regexp_extract(rest, '^[^/?#]*') raw from r),
p as (select page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path,
        translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low from h),
f as (select *,
        case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
             when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
             when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
             when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end rule from p)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when regexp_matches(low, '/robots\.txt\z') then 'allow'
       when regexp_matches(low, '://[^/?#]*\bspam-farm\.') or regexp_matches(low, '://[^/?#]*\bcheap-pills\.')
         or regexp_matches(low, '://[^/?#]*\bcasino\b') or regexp_matches(low, '://(?:[^/?#]*\.)?ads\.')
         or regexp_matches(low, '/wp-login\.php(?:\z|[?#])') or regexp_matches(low, '[?&]sessionid=') then 'block'
       else 'allow' end verdict
from f
""")
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL under the scope rules, then the pattern rules."""
    return url_filter.judge(table(spark, folder, "pages", ["page_id", "url"]), "url", ["page_id"])


@_query(r"""
with w as (select doc_id, coalesce(text, '') text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines
  from documents),
windows as (select doc_id, i, array_to_string(words[i:i + 7], ' ') win
  from (select doc_id, words, unnest(range(1, len(words) - 6)) i from w)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) n from windows) where n >= 2),
covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + 8)) p from twice) group by doc_id),
m as (select w.doc_id, len(words) n_words, length(array_to_string(words, '')) word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols,
    len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(c.n, 0) n_repeat_words,
    len(list_filter(regexp_extract_all(text, '\p{L}+'), lambda x: regexp_full_match(x, '\p{Lu}{2,}'))) n_upper_words
  from w left join covered c using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
  cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 2 * n_words or (n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines)
    or word_chars < 2 * n_words or word_chars > 15 * n_words or 100 * n_upper_words > 40 * n_words) kept
from b
""")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of every document and the verdict of the current policy."""
    rows = quality_rules.ledger(table(spark, folder, "documents", ["doc_id", "text"]))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.BASE).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), quality_rules.kept().alias("kept"))


def _shard_sql(shards: int) -> str:
    return f"""(select arg_max(s, struct_pack(a := -1.0 / ln((cast(('0x' || substr(md5(name || ':' || s), 1, 13)) as bigint) + 0.5)
        / 4503599627370496.0), b := -s)) from range({shards}) t(s))"""


@_query(rf"""
with crc_table as (select list(c order by i) t from (select i,
    list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) c
  from range(256) r(i))),
d as (select doc_id, coalesce(cast(doc_id as varchar), 'null') name, strlen(coalesce(text, '')) + 1 size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint)) bytes from documents),
k as (select doc_id, name, size,
    xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) crc
  from d, crc_table),
s as (select *, cast({_shard_sql(16)} as integer) shard, cast({_shard_sql(17)} as integer) grown_shard,
    cast(('0x' || substr(md5(name || ':' || crc || ':' || size), 1, 13)) as bigint) % {sharding.BUCKETS} bucket from k)
select doc_id, cast(size as bigint) size, cast(crc as bigint) text_crc32, 'key' law, shard,
  row_number() over (partition by shard order by bucket, doc_id, crc, size) - 1 slot, grown_shard
from s
""")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Documents over 16 equal shards by rendezvous hashing of doc_id, and over 17."""
    whole = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents", ["doc_id", "text"]).select(
        "doc_id", (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"),
        F.lit("key").alias("law"))
    placed = sharding.assign(rows, "doc_id", [1.0] * sharding.SHARDS)
    slots = sharding.with_slots(placed, "doc_id", ["text_crc32", "size"])
    grown = sharding.rendezvous(F.col("doc_id"), [1.0] * (sharding.SHARDS + 1))
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", grown.alias("grown_shard"))


@_query(r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) g from w),
n as (select w.doc_id, count(g) n from w left join s using (doc_id) group by w.doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
r as (select doc_id, doc_id as reach from n union select r.doc_id, e.y from r join e on e.x = r.reach)
select n.doc_id, n.n n_shingles, min(reach) component_id from n join r using (doc_id) group by n.doc_id, n.n
""")
def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are 85 % alike."""
    return jaccard.jaccard_components(table(spark, folder, "documents", ["doc_id", "text"]), "doc_id", "text", 4, 85)


@_query(r"""
with l as (select doc_id, unnest(range(len(ls))) i, unnest(ls) line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
o as (select key, min(doc_id) owner from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, o.owner is not null and o.owner <> doc_id dropped from k left join o using (key))
select doc_id, count(*) n_lines, cast(sum(cast(dropped as int)) as bigint) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) kept_sha256
from m group by doc_id
""")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that a smaller doc_id holds."""
    return line_dedup.dedup_lines(table(spark, folder, "documents", ["doc_id", "text"]), "doc_id", "text", digests=True)


TOKENIZER, CLOSING_ID = public_tokenizers.path("word_bpe_49k.json"), 2


@_query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids in sequences of 4096."""
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    return packing.pack_documents(docs, "doc_id", "text", TOKENIZER, CLOSING_ID)


@_query()
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again; ids and bytes as digests."""
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    return bpe.encode_rows(docs, "text", ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN, ids=False)


META = ("lang", "source", "n_chars")


@_query()
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's score by two co-trained views, and whether it is kept."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    models = quality_classifier.fit(docs, labels, "doc_id", "text", META)
    rows = quality_classifier.score(docs, models, "text", META, keep=["doc_id"])
    return rows.select("doc_id", "score", "kept", "p_text", "p_meta")


@_query(r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
b as (select doc_id, y, substr(x, 2 * y + 1, 898) x from (select doc_id, x, unnest(range(0, length(x) // 2, 400)) y from d)),
w as (select doc_id, y, x, unnest(range(least(400, length(x) // 2 - 49))) i from b),
s as (select doc_id, y + i as i, substr(x, 2 * i + 1, 100) win from w),
o as (select win, min(doc_id) owner from s group by win),
c as (select doc_id, i from s join o using (win) where owner < doc_id),
f as (select *, sum(fresh) over (partition by doc_id order by i) z from (
    select *, cast(i - lag(i, 1, -51) over (partition by doc_id order by i) > 50 as int) fresh from c)),
g as (select doc_id, min(i) lo, max(i) + 50 hi from f group by doc_id, z),
p as (select *, lag(hi, 1, 0) over (partition by doc_id order by lo) done from g),
k as (select doc_id, sum(hi - lo) n, count(*) spans, max(hi) last,
    string_agg(substr(x, 2 * done + 1, 2 * (lo - done)), '' order by lo) x from p join d using (doc_id) group by doc_id)
select doc_id, cast(length(d.x) // 2 as bigint) n_bytes, cast(coalesce(n, 0) as bigint) n_removed,
  cast(coalesce(spans, 0) as bigint) n_spans, sha256(unhex(coalesce(k.x, '') || substr(d.x, 2 * coalesce(last, 0) + 1))) kept_sha256
from d left join k using (doc_id)
""")
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 50-byte windows that a smaller doc_id holds."""
    return suffix_dedup.dedup_digests(table(spark, folder, "documents", ["doc_id", "text"]), "doc_id", "text")


_CRC_TABLE = """crc_table as (select list(c order by i) t from (select i,
    list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) c
  from range(256) r(i)))"""


def _crc_sql(text: str) -> str:
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast('0x' || x as bigint))"
    return f"""xor(list_reduce(list_prepend(4294967295, {values}),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"""


@_query(rf"""
with {_CRC_TABLE},
o as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
    {_crc_sql("cast(doc_id as varchar)")} h from documents, crc_table),
r as (select doc_id, ws, len(ws) n, h % 10 = 0 and len(ws) > 0 as again, case when len(ws) > 0 then (h // 10) % len(ws) end a,
    3 + (h // 10) % 8 k from o),
m as (select doc_id, n, case when again then list_transform(range(n), lambda i:
    ws[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // k) end]) else ws end ws from r),
w as (select doc_id, n, unnest(range(n)) i, unnest(ws) word from m),
e as (select x.doc_id, y.i - x.i q, x.i from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i
  and 4 * (y.i - x.i) <= x.n),
l as (select doc_id, q, min(i) s, count(*) + q z from (
    select *, i - row_number() over (partition by doc_id, q order by i) g from e) group by doc_id, q, g),
f as (select doc_id, s, z, min(q) q from l where z >= greatest(6, 4 * q) group by doc_id, s, z),
best as (select doc_id, count(*) n_runs, string_agg(s || ',' || z || ',' || q || chr(10), '' order by s, q) listed,
    arg_max(struct_pack(s := s, z := z, q := q), struct_pack(x := z / q, s := -s, q := -q)) b from f group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + z)) i from f),
kept as (select doc_id, string_agg(word, ' ' order by i) x from w anti join gone using (doc_id, i) group by doc_id)
select doc_id, cast(coalesce(n_runs, 0) as bigint) n_runs, cast(b.s as bigint) as "start", cast(b.z as bigint) as "length",
  cast(b.q as bigint) as period, cast(1000 * b.z // b.q as bigint) exponent_milli, sha256(coalesce(listed, '')) runs_sha256,
  sha256(coalesce(x, '')) collapsed_sha256
from documents left join best using (doc_id) left join kept using (doc_id)
""")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of every document, after one document in ten has been made to repeat itself from some word on."""
    # Ids of no document have no crc, so their texts stay as they are.
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = table(spark, folder, "documents", ["doc_id", "text"]).select(
        "doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = docs.select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    placed = chosen.select("doc_id", "text", "words", n.alias("n"), F.when(n > 0, F.pmod(g, n)).cast("int").alias("a"), g.alias("g"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    again = F.expr("""array_join(slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p),
        cast(ceil((n - a) / p) as int)))), 1, n), ' ')""")
    rows = placed.withColumn("p", p).select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
    return periodic_runs.periodic_runs(rows, "doc_id", "text")


def slips(doc: int | None, counts: dict[str, int]) -> Iterator[tuple[str, int]]:
    """A document's words, some of them with a letter left out; a null id counts as an empty one."""
    start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
    for word, n in counts.items():
        h = zlib.crc32(word.encode(), start)
        if h % 97 == 0:
            at = h % len(word)
            yield word[:at] + word[at + 1:], n
        else:
            yield word, n


@_query(rf"""
with recursive {_CRC_TABLE},
w as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) w from documents),
c as (select doc_id, w, count(*) n from w group by doc_id, w),
h as (select w, n, {_crc_sql("concat(doc_id, ':', w)")} h from c, crc_table),
v as (select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end word, sum(n) n
  from h group by 1 having sum(n) >= 3 and length(word) >= 5),
x as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) less from (
    select word, n, unnest(range(1, length(word) + 1)) i from v)),
longer as (select distinct x.word a, x.n a_n, v.word b, v.n b_n from x join v on x.less = v.word),
near as (select a word, b near, b_n m from longer union all select b, a, a_n from longer
  union all select x.word, y.word, y.n from x join x y on x.less = y.less and x.i = y.i and x.word <> y.word),
best as (select word, count(*) n_near, arg_min(near, struct_pack(m := -m, near := near)) near, max(m) m from near group by word),
f as (select v.word, v.n, case when m >= 2 * v.n then near end form, coalesce(n_near, 0) n_near,
    case when m >= 2 * v.n then m end form_n from v left join best using (word)),
r as (select word, word as root, 0 as step from f union all select r.word, f.form, step + 1 from r join f on f.word = r.root
  where f.form is not null),
l as (select word, arg_max(root, step) root from r group by word)
select word, form, root, cast(n as bigint) n, cast(n_near as bigint) n_near, cast(form_n as bigint) form_n from f join l using (word)
""")
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word, the form that it is a slip of, and the root of its forms."""
    return spelling.spelling_variants(table(spark, folder, "documents", ["doc_id", "text"]), "doc_id", "text", slips)
