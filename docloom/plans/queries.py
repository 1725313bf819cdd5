"""The registered queries, each beside the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docloom.functions import quality as Q
from docloom.functions import text as T
from docloom.operators import keywords as K
from docloom.operators import match as M
from docloom.operators import pages as G
from docloom.operators import paragraphs as P
from docloom.operators import retrieval as R
from docloom.operators import store as S
from docloom.operators import vectors as V
from docloom.operators.keyed import KeyedTable
from docloom.plans import answering as N
from docloom.plans import ingest as I
from docloom.plans import reprocess as A
from docloom.sources.files import spread
from docloom.sources.scratch import scratch

_QUERIES, _SQL = {}, {}
NBSP, ZWSP = " ", "​"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


# Derived inputs: the tables hold no Thai, bullets, markdown or dirt of their own.
def dirty(spark, d):
    x = F.replace(F.replace("text", F.lit(" "), F.lit(f"{NBSP} \t{ZWSP}")), F.lit("\n"), F.lit(" \r\n\n\n\n "))
    return t(spark, d, "documents").select("doc_id", F.concat(F.lit("  "), x, F.lit(" co-\nop ")).alias("text"))


DIRTY = f"select doc_id, concat('  ', replace(replace(text, ' ', '{NBSP} \t{ZWSP}'), '\n', ' \r\n\n\n\n '), ' co-\nop ') as text from documents"


def thai_mix(spark, d):
    c = t(spark, d, "conversations")
    x = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("ระเบียบ การ รับสมัคร\tนักศึกษา a\tb "), F.col("text"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("ทุน การศึกษา "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", x.alias("text"))


THAI_MIX = "select conv_id, turn, case conv_id % 3 when 0 then concat('ระเบียบ การ รับสมัคร', chr(9), 'นักศึกษา a', chr(9), 'b ', text) when 1 then concat('ทุน การศึกษา ', text) else text end as text from conversations"
TIDY = lambda c: f"regexp_replace(regexp_replace({c}, '([฀-๿])\\s+([฀-๿])', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g')"


def outline(spark, d):
    x = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("1.2. "), "text")).when((F.col("turn") % 4).isin(2, 3), F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", x.alias("text"))


OUTLINE = "select conv_id, turn, case when turn % 4 = 1 then concat('1.2. ', text) when turn % 4 in (2, 3) then concat('- ', text) else text end as text from conversations"


def framed(spark, d):
    w = W.partitionBy("source").orderBy("doc_id")
    return t(spark, d, "documents").select("source", F.row_number().over(w).alias("page_no"), F.concat(F.lit("Handbook "), "source", F.lit("\n"), "text", F.lit("\nPage footer "), "source").alias("text"))


FRAMED = "select source, row_number() over (partition by source order by doc_id) as page_no, concat('Handbook ', source, '\n', text, '\nPage footer ', source) as text from documents"

CLEAN = r"""
with a as (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') x from (""" + DIRTY + r""")),
b as (select doc_id, regexp_replace(translate(x, '""" + NBSP + ZWSP + r"""', ' '), '[ \t]+', ' ', 'g') x from a),
c as (select doc_id, regexp_replace(trim(regexp_replace(x, ' *\n *', chr(10), 'g'), ' '), '\n{3,}', chr(10) || chr(10), 'g') x from b),
e as (select doc_id, regexp_replace(x, '([A-Za-z0-9])-\n([A-Za-z0-9])', '\1\2', 'g') x from c)
select doc_id, sha1(trim(x, e' \n\t')) as digest, length(trim(x, e' \n\t')) as n_chars from e
"""


@query(CLEAN)
def clean_text(spark, d):
    x = T.clean_for_index(F.col("text"))
    return dirty(spark, d).select("doc_id", x.alias("x")).select("doc_id", F.sha1("x").alias("digest"), F.length("x").cast("long").alias("n_chars"))


@query(f"select conv_id, turn, {TIDY('text')} as tidy from ({THAI_MIX})")
def thai_tidy(spark, d):
    return thai_mix(spark, d).select("conv_id", "turn", T.tidy_thai(F.col("text")).alias("tidy"))


TQ = r"(length(regexp_replace(text, '[^\p{L}\p{Nd}²³¹]', '', 'g')) / greatest(1, length(regexp_replace(text, '\s', '', 'g'))))"
OQ = r"(case when regexp_replace(text, '\s', '', 'g') = '' then 0.0 else greatest(0.0, 1 - length(regexp_replace(text, '[\p{L}\p{N}_ก-ฮะ-์\s.,;:!?()\[\]/\-]', '', 'g')) / length(text)) end)"


@query(f"select doc_id, round({TQ}, 6) as text_score, round({OQ}, 6) as ocr_score from documents")
def quality_scores(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", F.round(Q.text_quality(c), 6).alias("text_score"), F.round(Q.ocr_quality(c), 6).alias("ocr_score"))


@query(rf"select doc_id, (length(trim(text, e' \n\t')) < 50 or {TQ} < 0.2) as needs_ocr, case when regexp_matches(text, '[A-Za-z]') then 'tha+eng' else 'tha' end as ocr_lang from documents")
def ocr_decision(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", Q.needs_ocr(c).alias("needs_ocr"), Q.ocr_language(c).alias("ocr_lang"))


@query(rf"select doc_id, case when length(trim(text, e' \n\t')) >= 30 and lang in ('th', 'en') and {OQ} >= 0.7 then 'ok' else 'flagged' end as status, round({OQ}, 6) as quality_score from documents")
def valid_flag(spark, d):
    ok = Q.valid_ocr(F.col("text"), F.col("lang"))
    return t(spark, d, "documents").select("doc_id", F.when(ok, "ok").otherwise("flagged").alias("status"), F.round(Q.ocr_quality(F.col("text")), 6).alias("quality_score"))


@query(rf"""
with c as (select conv_id, turn, text, length(regexp_replace(text, '[^฀-๿]', '', 'g')) a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) b from ({THAI_MIX})),
r as (select *, a / greatest(a + b, 1) as th, b / greatest(a + b, 1) as la from c)
select conv_id, turn, round(th, 6) as thai_ratio, round(la, 6) as latin_ratio,
  case when th >= 0.8 then 'th' when la >= 0.8 then 'en' when th >= 0.4 and la >= 0.2 then 'mixed' else 'unknown' end as label,
  coalesce(a / nullif(length(text), 0) >= 0.5, false) as mostly_thai from r""")
def script_language(spark, d):
    c = F.col("text")
    th, la = Q.script_ratios(c)
    return thai_mix(spark, d).select("conv_id", "turn", F.round(th, 6).alias("thai_ratio"), F.round(la, 6).alias("latin_ratio"), Q.language_label(c).alias("label"), Q.mostly_thai(c).alias("mostly_thai"))


@query("select doc_id, greatest(1, ceil(length(text) / 4.0))::bigint as est_tokens, greatest(1, round_even(length(text) / 4.0, 0))::bigint as heuristic_tokens from documents")
def token_estimates(spark, d):
    return t(spark, d, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("est_tokens"), T.counted_tokens(F.col("text")).alias("heuristic_tokens"))


@query("select doc_id, left(sha1(concat_ws('|', source, (doc_id % 7)::varchar, doc_id::varchar)), 32) as chunk_key, left(sha1(concat_ws('|', source, '1', '1', trim(left(text, 64), e' \n\t'))), 24) as short_key from documents")
def doc_ids(spark, d):
    head = F.regexp_replace(F.left("text", F.lit(64)), "^\\s+|\\s+$", "")
    return t(spark, d, "documents").select("doc_id", T.chunk_id(F.col("source"), F.col("doc_id") % 7, F.col("doc_id")).alias("chunk_key"), F.substring(F.sha1(F.concat_ws("|", "source", F.lit("1"), F.lit("1"), head)), 1, 24).alias("short_key"))


@query("""with h as (select doc_id, sha1(unhex(replace('6ba7b811-9dad-11d1-80b4-00c04fd430c8', '-', '')) || encode(concat(source, '|', doc_id::varchar))) as h from documents)
select doc_id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', (('0x' || h[17:17])::int & 3) + 1, 1), h[18:20], '-', h[21:32]) as point_id from h""")
def point_ids(spark, d):
    return t(spark, d, "documents").select("doc_id", T.name_uuid(F.concat_ws("|", "source", F.col("doc_id").cast("string"))).alias("point_id"))


@query(rf"""with p as ({FRAMED}), f as (select source, string_agg(text, chr(10) order by page_no) as text from p where page_no <= 3 group by source),
l as (select source, case when length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(1, length(regexp_replace(text, '[^A-Za-z฀-๿]', '', 'g'))) >= 0.15 then 'tha+eng' else 'tha' end as lang from f)
select source, page_no, case when length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(1, length(regexp_replace(text, '[^A-Za-z฀-๿]', '', 'g'))) >= 0.15 then 'tha+eng' else lang end as ocr_lang from p join l using (source)""")
def page_languages(spark, d):
    return G.page_languages(framed(spark, d)).select("source", F.col("page_no").cast("long").alias("page_no"), "ocr_lang")


@query(r"""
with s as (select page_id, regexp_replace(lower(regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1')), '[^0-9A-Za-z฀-๿]+', '_', 'g') x from pages),
n as (select page_id, trim(x, '_') x from s), m as (select page_id, case when x = '' then 'document' else x end x from n)
select page_id, case when x like '%.txt' then x else x || '.txt' end as name from m""")
def doc_names(spark, d):
    return t(spark, d, "pages").select("page_id", T.document_name(F.col("url")).alias("name"))


@query(r"select conv_id, turn, sha1(trim(text, e' \n\t')) as digest from conversations")
def strip_markdown(spark, d):
    x = F.concat(F.lit("## Title\n- item\n"), "text", F.lit("\n```code```\n"))
    marked = t(spark, d, "conversations").select("conv_id", "turn", x.alias("text"))
    stripped = F.regexp_replace(T.strip_markdown(F.col("text")), "^Title\\nitem\\n", "")
    return marked.select("conv_id", "turn", F.sha1(F.regexp_replace(stripped, "^\\s+|\\s+$", "")).alias("digest"))


@query(rf"select conv_id, turn, regexp_matches(trim(text, e' \n\t'), '{T.HEADING}') as is_heading, regexp_matches(trim(text, e' \n\t'), '{T.BULLET}') as is_bullet, length(trim(text, e' \n\t')) as n_chars from ({OUTLINE}) where trim(text, e' \n\t') <> ''")
def paragraph_explode(spark, d):
    return P.tagged(outline(spark, d)).select("conv_id", "turn", "is_heading", "is_bullet", F.length("text").cast("long").alias("n_chars"))


@query(rf"""
with p as (select conv_id, turn, trim(text, e' \n\t') as text, turn % 4 in (2, 3) as b from ({OUTLINE})),
q as (select *, coalesce(lag(b) over (partition by conv_id order by turn), false) as pb from p),
r as (select *, sum(case when b and pb then 0 else 1 end) over (partition by conv_id order by turn) as island from q)
select conv_id, min(turn) as turn, count(*) as n_paras, sha1(string_agg(text, chr(10) order by turn)) as digest from r group by conv_id, island""")
def bullet_islands(spark, d):
    return P.bullet_islands(outline(spark, d), "conv_id", "turn").select("conv_id", "turn", "n_paras", F.sha1("text").alias("digest"))


@query(r"""select doc_id, len(x) as n_sentences, sha1(array_to_string(x, '|')) as digest
from (select doc_id, string_split(regexp_replace(text, '([.!?…ฯ๛ๆ])\s+', '\1' || chr(1), 'g'), chr(1)) as x from documents)""")
def sentence_split(spark, d):
    return t(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("long").alias("n_sentences"), F.sha1(F.array_join("x", "|")).alias("digest"))


EDGES = f"""with p as ({FRAMED}), l as (select source, page_no, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as l from p),
e as (select source, 'header' as side, unnest(l[1:2]) as line from l union all select source, 'footer', unnest(l[greatest(len(l) - 1, 1):len(l)]) from l),
m as (select source, greatest(3, count(*) // 4) as min_occ from p group by source),
k as (select source, side, line, count(*) as n from e group by all)"""


@query(EDGES + " select k.source, side, line, n, min_occ from k join m using (source) where n >= min_occ and length(line) >= case when side = 'header' then 5 else 3 end")
def header_footer_detect(spark, d):
    return P.headers_footers(framed(spark, d)).select("source", "side", "line", "n", F.col("min_occ").cast("long").alias("min_occ"))


@query(f"select source, page_no, sha1(concat(chr(10), text, chr(10))) as digest, concat('Handbook ', source) as header, concat('Page footer ', source) as footer from (select source, row_number() over (partition by source order by doc_id) as page_no, text from documents)")
def header_footer_strip(spark, d):
    return P.strip_headers_footers(framed(spark, d)).select("source", F.col("page_no").cast("long").alias("page_no"), F.sha1("body").alias("digest"), "header", "footer")


@query("select n_nationkey, concat_ws(' | ', n_nationkey::varchar, nullif(trim(n_name), ''), n_regionkey::varchar) as line from nation")
def sheet_text(spark, d):
    n = t(spark, d, "nation")
    cells = F.filter(F.transform(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in n.columns]), lambda x: F.trim(x)), lambda x: x != "")
    return n.select("n_nationkey", F.array_join(cells, " | ").alias("line"))


@query()
def ingest_chunks(spark, d):
    """Every document as a file of one page, to numbered and flagged chunks."""
    pages = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit(1).alias("page_no"), "text")
    rows = I.flagged_chunks(pages, f"{scratch(spark)}/numbered")
    return rows.select(F.col("source").cast("long").alias("doc_id"), "chunk", F.col("chunk_id").alias("ordinal"), F.col("doc_id").alias("chunk_key"), "status", "tokens_est", F.sha1("text").alias("digest"))


ISLANDS = rf"""p as (select conv_id, turn, trim(text, e' \n\t') as text, regexp_matches(trim(text, e' \n\t'), '{T.HEADING}') as h, regexp_matches(trim(text, e' \n\t'), '{T.BULLET}') as b from ({OUTLINE}) where trim(text, e' \n\t') <> ''),
q as (select *, coalesce(lag(b) over (partition by conv_id order by turn), false) as pb from p),
r as (select *, sum(case when b and pb then 0 else 1 end) over (partition by conv_id order by turn) as island from q),
g as (select conv_id, min(turn) as page, string_agg(text, chr(10) order by turn) as text, bool_or(h) as h, island as i from r group by conv_id, island)"""


def _chunked(heading_tail: str) -> str:
    """The fold of paragraphs within the budget as a recursion: what is held, and what the step closes."""
    sql = r"""with recursive ISLANDS, n as (select conv_id, max(i) as n from g group by conv_id),
s as (select *, greatest(1, ceil(length(text) / 4.0))::bigint as size from g union all select conv_id, null, null, true, n + 1, 0 from n),
f as (
  select conv_id, 0::bigint as i, null::varchar as held, 0::bigint as used, null::bigint as ps, null::bigint as pe, -1::bigint as chunk, null::varchar as body, null::bigint as bs, null::bigint as be, false as tail from n
  union all
  select conv_id, i, case when shut then text else held || chr(10) || chr(10) || text end, case when shut then size else used + size end,
    case when shut then page else least(ps, page) end, case when shut then page else greatest(pe, page) end,
    case when shut and held is not null then chunk + 1 else chunk end, case when shut then held end, ps, pe, text is not null and (not h or TAIL)
  from (select s.*, held, used, ps, pe, chunk, held is null or h or used + size > 800 as shut from f join s on s.conv_id = f.conv_id and s.i = f.i + 1)
), c as (select conv_id, chunk, bs as page_start, be as page_end, case when tail and floor(0.12::double * length(body)) > 0 then right(body, floor(0.12::double * length(body))::bigint) || chr(10) || body else body end as text from f where body is not null)
select conv_id, chunk, sha1(text) as digest, page_start, page_end, greatest(1, ceil(length(text) / 4.0))::bigint as tokens_est from c"""
    return sql.replace("ISLANDS", ISLANDS).replace("TAIL", heading_tail)


@query(_chunked("false"))
def chunk_pages_notebook(spark, d):
    return P.chunks(outline(spark, d), "conv_id", "turn", "turn", batch=True).select("conv_id", "chunk", F.sha1("text").alias("digest"), "page_start", "page_end", "tokens_est")


@query(r"""select item_id, regexp_replace(replace(concat('(', text, '): "', text, '" - a/b?'), '"', '""'), '[/()\-:*?\[\]{}]', ' ', 'g') as asked from benchmark""")
def query_sanitized(spark, d):
    x = F.concat(F.lit("("), "text", F.lit('): "'), "text", F.lit('" - a/b?'))
    return t(spark, d, "benchmark").select("item_id", T.sanitized_query(x).alias("asked"))


@query(_chunked("true"))
def chunk_pages(spark, d):
    return P.chunks(outline(spark, d), "conv_id", "turn", "turn").select("conv_id", "chunk", F.sha1("text").alias("digest"), "page_start", "page_end", "tokens_est")


TOK = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"


@query(f"""with w as (select doc_id, generate_subscripts(x, 1) as pos, unnest(x) as term from (select doc_id, {TOK} as x from documents)),
c as (select doc_id, term, count(*) as n, min(pos) as first_pos from w where length(term) >= 2 and term not in ('the', 'and', 'of') group by all)
select doc_id, term, n, rk from (select *, row_number() over (partition by doc_id order by n desc, first_pos) as rk from c) where rk <= 5""")
def keyword_topn_terms(spark, d):
    return K.top_terms(t(spark, d, "documents"), 5, ("the", "and", "of")).select("doc_id", "term", "n", F.col("rank").alias("rk"))


@query(f"select doc_id, len({TOK}) as n_words from documents")
def word_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(T.index_tokens(F.col("text"))).cast("long").alias("n_words"))


TERMS = r"list_distinct(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"
WORDS = TERMS.format("text")
IN_ORDER = WORDS.removeprefix("list_distinct")  # list_distinct keeps no order


@query(f"""with q as (select item_id, {WORDS} as x from benchmark), dd as (select doc_id, {WORDS} as y from documents)
select item_id, doc_id, rk from (select item_id, doc_id, row_number() over (partition by item_id order by doc_id) as rk from q, dd where list_has_all(y, x) and len(x) > 0) where rk <= 30""")
def fts_match_and(spark, d):
    return R.top(R.match_all(t(spark, d, "benchmark"), t(spark, d, "documents")), "item_id", 30, F.col("doc_id")).select("item_id", "doc_id", F.col("rank").cast("long").alias("rk"))


FOLDED = r"list_filter(string_split_regex(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
HAS = lambda *at: "contains(y, concat(' ', " + ", ' ', ".join(f"coalesce(x[{i}], 'x')" for i in at) + ", ' '))"


@query(f"""with q as (select item_id, {FOLDED} as x from benchmark), dd as (select doc_id, concat(' ', array_to_string({FOLDED}, ' '), ' ') as y from documents),
m as (select item_id, doc_id from q, dd where case item_id % 6
  when 0 then len(x) > 0 and len(list_filter(x, lambda w: not contains(y, concat(' ', w, ' ')))) = 0
  when 1 then {HAS(1, 2, 3)} or ({HAS(4)} and {HAS(5)})
  when 2 then {HAS(1)} and ({HAS(2)} or {HAS(3)}) and not {HAS(4)}
  when 3 then {HAS(1)} and {HAS(2)} and not {HAS(3, 4)}
  when 4 then starts_with(y, concat(' ', coalesce(x[1], 'x'), ' ')) or {HAS(2, 3, 4)} end)
select item_id, doc_id, rk from (select *, row_number() over (partition by item_id order by doc_id) as rk from m) where rk <= 30""")
def fts_expressions(spark, d):
    """Expressions made of each question's words, every sixth one malformed; the first 30 matches of each."""
    x = T.folded_terms(F.col("text"))
    shapes = ['"%1$s %2$s %3$s" OR (%4$s AND %5$s)', "%1$s AND (%2$s OR %3$s) NOT %4$s", '%1$s %2$s NOT "%3$s %4$s"', '^%1$s OR "%2$s %3$s %4$s"', "%1$s AND (%2$s"]
    words, said = [F.coalesce(F.get("x", F.lit(i)), F.lit("x")) for i in range(5)], F.array_join("x", " ")
    for n, shape in enumerate(shapes, 1):
        said = F.when(F.col("item_id") % 6 == n, F.format_string(shape, *words)).otherwise(said)
    asked = t(spark, d, "benchmark").select("item_id", x.alias("x")).select("item_id", said.alias("text"))
    return M.keyword_search(M.match(asked, t(spark, d, "documents"), scratch(spark))).select("item_id", "doc_id", F.col("rank").cast("long").alias("rk"))


BM = f"""w as materialized (select doc_id, unnest({TOK}) as term from documents), tf as materialized (select doc_id, term, count(*) as tf from w group by all),
dl as materialized (select doc_id, len({TOK}) as dl from documents), st as materialized (select count(*) as n, avg(dl) as avgdl from dl),
df as materialized (select term, count(*) as df from tf group by term), raw as materialized (select term, df, ln((select n from st) - df + 0.5) - ln(df + 0.5) as r from df),
idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw),
q as (select item_id, term, count(*) as times from (select item_id, unnest({TOK}) as term from benchmark) group by all),
sc as (select item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from q join tf using (term) join idf using (term) join dl using (doc_id), st group by item_id, doc_id)"""


@query(f"""with q as (select item_id, {IN_ORDER} as x from benchmark), dd as (select doc_id, {WORDS} as y from documents)
select item_id, doc_id from q, dd where list_contains(y, x[1]) and (len(x) < 2 or list_has_any(y, x[2:5])) and not coalesce(list_contains(y, x[6]), false)""")
def fts_match_boolean(spark, d):
    """A question's first word, one of the next four if there are any, and not its sixth if it has one."""
    x = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    q = t(spark, d, "benchmark").select("item_id", x.alias("x"))
    q = q.select("item_id", F.slice("x", 1, 1).alias("every"), F.slice("x", 2, 4).alias("any"), F.slice("x", 6, 1).alias("none"))
    return R.match_boolean(q, t(spark, d, "documents"))


@query()
def page_fallback(spark, d):
    """Pages with every fifth text layer missing, and two OCR texts of each page, one of them noisy."""
    docs = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("whole"))
    pages = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("whole")).alias("text"), F.lit("text layer").alias("method"))
    ocr = docs.select("doc_id", F.translate("whole", "aeo", "#%~").alias("first"), F.col("whole").alias("second"))
    return G.with_fallback(pages, ocr, ["doc_id"]).select("doc_id", "method", F.sha1("text").alias("digest"))


@query(f"with {BM} select term, df, round(idf, 6) as idf from idf")
def bm25_index_stats(spark, d):
    docs = t(spark, d, "documents")
    return R.term_weights(*K.tally(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""with {BM}, al as (select item_id, doc_id, coalesce(score, 0) as score from benchmark cross join documents left join sc using (item_id, doc_id))
select item_id, doc_id, score, rk from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rk from al) where rk <= 10""")
def bm25_topk(spark, d):
    """The best ten of each question, filled up with documents of score 0."""
    docs, asked = t(spark, d, "documents").select("doc_id", "text"), t(spark, d, "benchmark")
    s = R.filled_up(K.top_documents(asked, docs, 10).drop("rank"), asked, docs, 10)
    return s.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rk"))


@query(f"with {BM} select item_id, doc_id, score, rk from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rk from sc) where rk <= 10")
def bm25_index_topk(spark, d):
    """From a written index."""
    path = scratch(spark)
    R.write_index(t(spark, d, "documents").select("doc_id", "text"), path, parts=8)
    return R.index_top(t(spark, d, "benchmark"), path, 10).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rk"))


@query(f"""with {BM}, o as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rk from sc),
f as (select o.*, row_number() over (partition by item_id order by rk) as rk2 from o join documents using (doc_id) where rk <= 100 and source = 'src1')
select item_id, doc_id, score, rk2 as rk from f where rk2 <= 20""")
def bm25_filtered_post(spark, d):
    docs = t(spark, d, "documents")
    wide = K.top_documents(t(spark, d, "benchmark"), docs, 100).drop("rank")
    own = wide.join(docs.where("source = 'src1'").select("doc_id"), "doc_id", "left_semi")
    return R.top(own, "item_id", 20, F.desc("score"), F.col("doc_id")).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rk"))


DOT = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::double * z[2]::double)), 6) + 0.0"


def _vectors(where: str) -> str:
    return f"select query_id, vec_id, score, rk from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rk from (select a.vec_id as query_id, b.vec_id as vec_id, {DOT} as score from embeddings a, embeddings b where a.vec_id % 100 = 0 {where})) where rk <= 12"


def _vector_top(spark, d, where):
    v = t(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.top_vectors(q, v.where(where), 12).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rk"))


@query(_vectors(""))
def vector_topk(spark, d):
    return _vector_top(spark, d, "true")


@query(_vectors("and b.label = 3"))
def vector_topk_filtered(spark, d):
    return _vector_top(spark, d, "label = 3")


@query(_vectors(""))
def vector_collection(spark, d):
    """As ``vector_topk``, from a written collection in cells."""
    v, path = t(spark, d, "embeddings"), scratch(spark)
    V.write_collection(v, path)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.search_collection(q, path, 12).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rk"))


@query("""with s as (select vec_id, case when vec_id % 3 = 0 then embedding[1:60] else embedding end as e from embeddings)
select vec_id, 64::bigint as dim, round(list_sum(list_transform(e, lambda x: x::double)) + (64 - len(e)) * (list_sum(list_transform(e, lambda x: x::double)) / len(e))::float::double, 5) as total from s""")
def vector_dim_fix(spark, d):
    e = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    v = t(spark, d, "embeddings").select("vec_id", R.fit_dimension(e, 64).alias("e"))
    return v.select("vec_id", F.size("e").cast("long").alias("dim"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("""with b as (select doc_id, encode(case when text = '' then '0' else text end) as b from documents),
c as (select doc_id, i, ('0x' || hex(b)[(i % least(32, octet_length(b))) * 2 + 1:(i % least(32, octet_length(b))) * 2 + 2])::bigint * (i + 1) as x from b, range(32) r(i))
select doc_id, sum(x)::bigint % 9973 as last_value from c group by doc_id""")
def hash_vectors(spark, d):
    v = t(spark, d, "documents").select("doc_id", Q.hash_vector(F.col("text")).alias("v"))
    return v.select("doc_id", F.round(F.element_at("v", -1) * 9973).cast("long").alias("last_value"))


BYTES = """case when {t} = '' then '0' else {t} end"""
_VECTOR = lambda t, id_, name, where="": f"""{name}_b as (select {id_}, encode({BYTES.format(t="text")}) as b from {t} {where}),
{name}_c as (select {id_}, i, ('0x' || hex(b)[(i % least(32, octet_length(b))) * 2 + 1:(i % least(32, octet_length(b))) * 2 + 2])::bigint * (i + 1) as x from {name}_b, range(32) r(i)),
{name}_s as (select {id_}, i, (sum(x) over (partition by {id_} order by i) % 9973)::double / 9973 as x from {name}_c),
{name} as (select {id_}, list(x order by i) as v from {name}_s group by {id_})"""  # noqa: E731
NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
LEGS = f"""{BM}, kw as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rk from sc),
{_VECTOR('documents', 'doc_id', 'dv')}, {_VECTOR('benchmark', 'item_id', 'qv')},
du as (select doc_id, list_transform(v, lambda x: x / n) as v from (select *, {NORM.format(v='v')} as n from dv)),
qu as (select item_id, list_transform(v, lambda x: x / n) as v from (select *, {NORM.format(v='v')} as n from qv)),
v as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rk from (select item_id, doc_id, round(list_sum(list_transform(list_zip(qu.v, du.v), lambda z: z[1] * z[2])), 6) + 0.0 as score from qu, du)),
u as (select item_id, doc_id, 0 as leg, rk from v where rk <= 30 union all select item_id, doc_id, 1, rk from kw where rk <= 30),
g as (select item_id, doc_id, round(sum(1 / (60 + rk)), 8) as rrf, min(leg * 1000 + rk) as first_seen from u group by all),
fused as (select item_id, doc_id, rrf, row_number() over (partition by item_id order by rrf desc, first_seen, doc_id) as rk from g)"""


def _fused(spark, d, k):
    """All questions against all documents; the hash vector stands in for an embedding."""
    return R.hybrid(t(spark, d, "benchmark"), t(spark, d, "documents"), k)


@query(f"with {LEGS} select item_id, doc_id, rrf, rk from fused where rk <= 12")
def rrf_fusion(spark, d):
    return _fused(spark, d, 12).select("item_id", "doc_id", "rrf", F.col("rank").cast("long").alias("rk"))


@query(f"""with {LEGS}, p as (select f.item_id, f.doc_id, rk, greatest(1, ceil(length(concat('[', rk::varchar, '] ', trim(text, e' \\n\\t'))) / 4.0))::bigint as tk from fused f join documents using (doc_id) where rk <= 12),
s as (select *, sum(tk) over (partition by item_id order by rk) as used from p)
select item_id, coalesce(max(used) filter (used <= 1200), 0)::bigint as used_tokens, count(*) filter (used <= 1200) as n_blocks from s group by item_id""")
def hybrid_rrf(spark, d):
    """Flagship: keyword leg, second leg, rank fusion, packed context."""
    hits = _fused(spark, d, 12).join(t(spark, d, "documents").select("doc_id", "text", F.col("source").alias("cite")), "doc_id")
    return R.pack_context(hits, "item_id").select("item_id", F.col("used_tokens").cast("long").alias("used_tokens"), "n_blocks")


@query(f"""with {LEGS}, r as (select f.item_id, f.doc_id, round(len(list_intersect(list_distinct(qt), list_distinct(dt))) / len(list_distinct(qt)), 6) as rerank
from fused f join (select item_id, {TOK} as qt from benchmark) using (item_id) join (select doc_id, {TOK} as dt from documents) using (doc_id) where rk <= 20)
select item_id, doc_id, rerank, rk from (select *, row_number() over (partition by item_id order by rerank desc, doc_id) as rk from r) where rk <= 8""")
def hybrid_rerank(spark, d):
    out = R.overlap_rerank(_fused(spark, d, 20), t(spark, d, "benchmark"), t(spark, d, "documents"), "item_id", "doc_id", 8)
    return out.select("item_id", "doc_id", "rerank", F.col("rank").cast("long").alias("rk"))


PACK = r"""with c as (select conv_id, turn + 1 as rk, text, role as cite from conversations),
b as (select conv_id, rk, concat('[', rk::varchar, '] ', trim(text, e' \n\t')) as block, concat('[', rk::varchar, '] ', cite) as cited, {tokens} as tk from c),
s as (select *, sum(tk) over (partition by conv_id order by rk) as used from b)
select conv_id, coalesce(max(used) filter (used <= 300), 0)::bigint as used_tokens, count(*) filter (used <= 300) as n_blocks, sha1(coalesce(string_agg(block, chr(10) || chr(10) order by rk) filter (used <= 300), '')) as ctx,
coalesce(string_agg(cited, chr(10) order by rk) filter (used <= 300), '') as cites from s group by conv_id"""


def _packed(spark, d, cited):
    c = t(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("rank"), "text", F.col("role").alias("cite"))
    return R.pack_context(c, "conv_id", 300, cited)


@query(PACK.format(tokens=r"greatest(1, ceil(length(concat('[', rk::varchar, '] ', trim(text, e' \n\t'))) / 4.0))::bigint"))
def pack_context_service(spark, d):
    return _packed(spark, d, False).select("conv_id", F.col("used_tokens").cast("long").alias("used_tokens"), "n_blocks", F.sha1("ctx").alias("ctx"), "cites")


@query(PACK.format(tokens=r"greatest(1, round_even(length(concat('[', rk::varchar, '] ', cite, chr(10), trim(text, e' \n\t'), chr(10))) / 4.0, 0))::bigint"))
def pack_context_notebook(spark, d):
    return _packed(spark, d, True).select("conv_id", F.col("used_tokens").cast("long").alias("used_tokens"), "n_blocks", F.sha1("ctx").alias("ctx"), "cites")


@query(f"""with k as ({PACK.format(tokens=r"greatest(1, ceil(length(concat('[', rk::varchar, '] ', trim(text, e' \n\t'))) / 4.0))::bigint").replace("sha1(coalesce(string_agg(block, chr(10) || chr(10) order by rk) filter (used <= 300), ''))", "coalesce(string_agg(block, chr(10) || chr(10) order by rk) filter (used <= 300), '')")}),
f as (select conv_id, min_by(text, turn) as question from conversations group by conv_id)
select conv_id, concat('คำถาม:\n', question, '\n\nบริบท:\n', ctx, '\n\nอ้างอิง:\n', cites, '\n') as prompt from k join f using (conv_id)""")
def prompt_build(spark, d):
    """Each conversation's first text as the question, its turns packed as the context."""
    first = t(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    rows = _packed(spark, d, False).join(first, "conv_id")
    return rows.select("conv_id", R.prompt(F.col("question"), F.col("ctx"), F.col("cites")).alias("prompt"))


@query(rf"""with c as (select conv_id, turn, {TIDY('text')} as text from ({THAI_MIX})),
r as (select *, length(regexp_replace(text, '[^฀-๿]', '', 'g')) a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) b, case when turn = 5 then concat(text, ' Phishing') else text end as q from c)
select conv_id, turn, case when a / greatest(a + b, 1) >= 0.55 or regexp_matches(text, '{S.ROUTED}') then 'A' else 'B' end as model, regexp_matches(lower(q), '{S.DENIED}') as denied from r""")
def route_deny(spark, d):
    c = thai_mix(spark, d).select("conv_id", "turn", T.tidy_thai(F.col("text")).alias("text"))
    asked = F.when(F.col("turn") == 5, F.concat("text", F.lit(" Phishing"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", S.route(F.col("text"), Q.script_ratios(F.col("text"))[0]).alias("model"), S.denied(asked).alias("denied"))


@query(f"select doc_id, sha1(regexp_replace(text, '{T.EMAIL}', '[REDACTED_EMAIL]', 'g')) as digest from documents")
def redact_email(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha1(F.regexp_replace("text", T.EMAIL, "[REDACTED_EMAIL]")).alias("digest"))


PERSONAL = "concat(text, ' id 1234567890123 end, a.b@ex-am.org; x1234567890123y')"
# the phone pattern's look-around written out: the signs beside a number are put back; twice, for numbers a sign apart
_BODY = T.PHONE.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)")
_PHONES = lambda c: f"regexp_replace({c}, '(^|[^0-9]){_BODY}($|[^0-9])', '\\1[REDACTED_PHONE]\\2', 'g')"
REDACTED = lambda c: f"regexp_replace({_PHONES(_PHONES(f"regexp_replace({c}, '{T.EMAIL}', '[REDACTED_EMAIL]', 'g')"))}, '\\b[0-9]{{13}}\\b', '[REDACTED_ID]', 'g')"


@query(f"select conv_id, turn, sha1({REDACTED(PERSONAL)}) as digest from conversations")
def redact_planted(spark, d):
    """Planted addresses and numbers behind the texts; a 13-digit number is a phone number first, as in the reference."""
    return t(spark, d, "conversations").select("conv_id", "turn", F.sha1(T.redact(F.expr(PERSONAL))).alias("digest"))


@query(f"select doc_id, {REDACTED('text')} as text from documents")
def redact_pii(spark, d):
    return t(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query()
def smart_paragraphs(spark, d):
    """Bullets are planted before every third line."""
    x = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("- "), x)).otherwise(x)), "\n")
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(T.smart_paragraphs(x)).alias("pos", "text"))
    return rows.select("doc_id", "pos", F.sha1("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query()
def rag_query(spark, d):
    """Whole composite: both legs, packed context, prompt."""
    docs = t(spark, d, "documents").select("doc_id", "text", "source", F.lit(None).cast("string").alias("path"), F.lit(1).alias("page"))
    return R.rag_query(t(spark, d, "benchmark"), docs).select("item_id", "prompt", F.size("contexts").cast("long").alias("n_contexts"), "token_est")


@query()
def answered(spark, d):
    """Denied, routed, generated and redacted; a generator that repeats its prompt stands in for a model."""
    asked = t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.when(F.col("turn") % 8 == 6, F.concat("text", F.lit(" phishing"))).otherwise(F.col("text")).alias("question"), F.lit("").alias("ctx"), F.lit("").alias("cites"))
    return R.answers(asked, lambda model, asked: F.concat(model, F.lit(": "), asked)).select("conv_id", "turn", "model", F.sha1("answer").alias("digest"))


OWNED = LEGS.replace("from qu, du)", "from qu, du join documents using (doc_id) where source = 'src1' and lang = 'en')").replace(
    "kw as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as rk from sc)",
    """kw_all as (select *, row_number() over (partition by item_id order by score desc, doc_id) as wide from sc),
kw as (select item_id, doc_id, row_number() over (partition by item_id order by wide) as rk from kw_all join documents using (doc_id) where wide <= 150 and source = 'src1' and lang = 'en')""")


@query(f"with {OWNED} select item_id, doc_id, rrf, rk from fused where rk <= 12")
def hybrid_filtered(spark, d):
    """Both legs under two filters: before the vector leg, after the keyword leg."""
    where = (F.col("source") == "src1") & (F.col("lang") == "en")
    return R.hybrid(t(spark, d, "benchmark"), t(spark, d, "documents"), 12, where=where).select("item_id", "doc_id", "rrf", F.col("rank").cast("long").alias("rk"))


#: Chunks of documents for the question query: the lines that are not blank.
LINES = r"""pieces as materialized (select doc_id * 1048576 + i as doc_id, text, source, i as page from (
select doc_id, source, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where trim(text, e' \n\t\r\x0b\x0c') <> '')"""


@query(rf"""with {LINES}, {LEGS.replace("documents", "pieces")},
r as (select f.item_id, f.doc_id, round(len(list_intersect(list_distinct(qt), list_distinct(dt))) / len(list_distinct(qt)), 6) as rerank
from fused f join (select item_id, {TOK} as qt from benchmark) using (item_id) join (select doc_id, {TOK} as dt from pieces) using (doc_id) where rk <= 20),
o as (select item_id, doc_id, row_number() over (partition by item_id order by rerank desc, doc_id) as rk from r),
b as (select item_id, rk, concat('[', rk::varchar, '] ', trim(text, e' \n\t')) as block, concat('[', rk::varchar, '] ', source, ':', page::varchar) as cited,
greatest(1, round_even(length(concat('[', rk::varchar, '] ', source, ':', page::varchar, chr(10), trim(text, e' \n\t'), chr(10))) / 4.0, 0))::bigint as tk from o join pieces using (doc_id) where rk <= 8),
s as (select *, sum(tk) over (partition by item_id order by rk) as used from b),
k as (select item_id, coalesce(max(used) filter (used <= 1200), 0)::bigint as used_tokens, count(*) filter (used <= 1200) as n_blocks,
coalesce(string_agg(block, chr(10) || chr(10) order by rk) filter (used <= 1200), '') as ctx, coalesce(string_agg(cited, chr(10) order by rk) filter (used <= 1200), '') as cites from s group by item_id),
m as (select item_id, cites, used_tokens, n_blocks, case when regexp_matches(lower(text), '{S.DENIED}') then 'deny' when regexp_matches(concat(text, ctx), '{S.ROUTED}') then 'A' else 'B' end as model,
concat('คำถาม:
', text, '

บริบท:
', ctx, '

อ้างอิง:
', cites, '
') as prompt from benchmark join k using (item_id))
select item_id, model, cites, used_tokens, n_blocks, sha1(case when model = 'deny' then '{R.REFUSAL}' else {REDACTED("concat(model, ': ', prompt)")} end) as digest from m""")
def qa_with_router(spark, d):
    """From question to redacted answer over chunks (the documents' lines); a generator that repeats its prompt stands in for a model."""
    lines = t(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    chunks = lines.where(F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) != "").select((F.col("doc_id") * 1048576 + F.col("i") + 1).alias("doc_id"), "text", "source", F.lit(None).cast("string").alias("path"), (F.col("i") + 1).alias("page"))
    out = N.answered_questions(t(spark, d, "benchmark"), chunks, lambda model, asked: F.concat(model, F.lit(": "), asked))
    return out.select("item_id", "model", "cites", "used_tokens", F.col("n_blocks").cast("long").alias("n_blocks"), F.sha1("answer").alias("digest"))


@query("select source, count(*) as n_flagged, row_number() over (order by count(*) desc, source) as rk from documents join labels using (doc_id) where quality = 0 group by source order by rk limit 10")
def flagged_top_files(spark, d):
    f = t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 0"), "doc_id").groupBy("source").agg(F.count("*").alias("n_flagged"))
    first = f.orderBy(F.desc("n_flagged"), "source").limit(10)
    return first.withColumn("rk", F.row_number().over(W.orderBy(F.desc("n_flagged"), "source")).cast("long"))


@query("""select rk, doc_id, case when length(text) > 150 then left(text, 150) || '...' else text end as preview, length(text) as n_chars
from (select row_number() over (order by doc_id) as rk, * from documents join labels using (doc_id) where quality = 0) where rk <= 3""")
def flagged_previews(spark, d):
    f = t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 0"), "doc_id").orderBy("doc_id").limit(3)
    view = F.when(F.length("text") > 150, F.concat(F.left("text", F.lit(150)), F.lit("..."))).otherwise(F.col("text"))
    return f.select(F.row_number().over(W.orderBy("doc_id")).cast("long").alias("rk"), "doc_id", view.alias("preview"), F.length("text").cast("long").alias("n_chars"))


@query("select doc_id + 5 as doc_id, n_chars from documents where doc_id + 5 not in (select doc_id from documents)")
def insert_or_ignore(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    again = docs.select((F.col("doc_id") + 5).alias("doc_id"), "n_chars")
    return S.insert_or_ignore(docs, again, "doc_id", "n_chars")


@query("select doc_id, case when doc_id % 10 = 0 then 2 else 1 end::bigint as batch, n_chars from documents")
def upsert_latest(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("batch"), "n_chars")
    return S.upsert(docs.unionByName(docs.where("doc_id % 10 = 0").withColumn("batch", F.lit(2).cast("long"))), "doc_id", "batch")


@query("""select doc_id, case when doc_id % 10 = 0 then 3 when doc_id % 2 = 0 or doc_id % 3 = 0 then 1 else 2 end::bigint as batch, n_chars from documents where doc_id % 7 <> 0
union all select doc_id + 1000000000, 3, n_chars from documents where doc_id % 10 = 0 and doc_id % 7 <> 0""")
def keyed_table(spark, d):
    """Two batches inserted, the second of them twice, one upserted with new keys, some keys deleted; read back."""
    docs = t(spark, d, "documents").select("doc_id", "n_chars")
    batch = lambda n, rows: rows.select("doc_id", F.lit(n).cast("long").alias("batch"), "n_chars")
    first = batch(1, docs.where("doc_id % 2 = 0 or doc_id % 3 = 0"))
    table = KeyedTable(spark, scratch(spark), first.schema, buckets=16)
    table.insert(first, "batch")
    for _ in range(2):
        table.insert(batch(2, docs), "batch")
    tenth = docs.where("doc_id % 10 = 0")
    table.upsert(batch(3, tenth.unionByName(tenth.withColumn("doc_id", F.col("doc_id") + 1_000_000_000))), "batch")
    gone = docs.where("doc_id % 7 = 0").select("doc_id")
    table.delete(gone.union(gone.select(F.col("doc_id") + 1_000_000_000)))
    return table.read()


@query(f"""with f as (select doc_id, source, regexp_replace(text, '[#$%&*|]+', '', 'g') as text from documents join labels using (doc_id) where quality = 0),
s as (select *, {OQ} as score, length(regexp_replace(text, '[^฀-๿]', '', 'g')) a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) b from f)
select doc_id, source, round(score, 6) as quality_score, score >= 0.3 and length(trim(text, e' \\n\\t')) >= 30 and (a / greatest(a + b, 1) >= 0.8 or b / greatest(a + b, 1) >= 0.8) and score >= 0.7 as accepted from s""")
def reprocess_pages(spark, d):
    """Every flagged document as a page of its source, read again by an engine that leaves out symbols."""
    docs = t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id")
    flagged = docs.select(F.lit(None).cast("string").alias("path"), "source", F.col("doc_id").alias("page_start"))
    again = docs.select(F.col("source").alias("path"), F.col("doc_id").cast("int").alias("page_no"), F.regexp_replace("text", "[#$%&*|]+", "").alias("text"))
    rows = A.judged_pages(flagged, again)
    return rows.select(F.col("page_no").cast("long").alias("doc_id"), F.col("path").alias("source"), F.round("quality_score", 6).alias("quality_score"), "accepted")


@query("select count(distinct d.source) as n_files, count(*) as n_records, count(*) filter (l.quality = 0) as n_flagged, count(*) filter (l.quality is distinct from 0) as n_embedded from documents d left join labels l using (doc_id)")
def ingest_summary(spark, d):
    rows = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return rows.agg(F.count_distinct("source").alias("n_files"), F.count("*").alias("n_records"), F.count_if(F.col("quality") == 0).alias("n_flagged"), F.count_if(~F.col("quality").eqNullSafe(0)).alias("n_embedded"))


@query("""select source, count(*) as n_flagged, min(length(text)) as shortest, max(length(text)) as longest, floor(avg(length(text)))::bigint as mean_length, count(*) filter (text = '') as n_empty, count(distinct doc_id % 7) as n_pages,
min_by(case when length(text) > 150 then left(text, 150) || '...' else text end, doc_id) as preview
from documents join labels using (doc_id) where quality = 0 group by source""")
def flagged_report(spark, d):
    f = t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 0"), "doc_id")
    n, view = F.length("text").cast("long"), F.when(F.length("text") > 150, F.concat(F.left("text", F.lit(150)), F.lit("..."))).otherwise(F.col("text"))
    return f.groupBy("source").agg(F.count("*").alias("n_flagged"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.floor(F.avg(n)).alias("mean_length"), F.count_if(F.col("text") == "").alias("n_empty"), F.count_distinct(F.col("doc_id") % 7).alias("n_pages"), F.min_by(view, "doc_id").alias("preview"))


@query(f"""select source, count(*) filter ({TQ} >= 0.3 and length(trim(text, e' \\n\\t')) >= 30 and lang in ('th', 'en') and {OQ} >= 0.7) as n_improved, count(*) as n_flagged
from documents join labels using (doc_id) where quality = 0 group by source""")
def reprocess_accept(spark, d):
    f = t(spark, d, "documents").join(t(spark, d, "labels").where("quality = 0"), "doc_id")
    ok = (Q.text_quality(F.col("text")) >= 0.3) & Q.valid_ocr(F.col("text"), F.col("lang"))
    return f.groupBy("source").agg(F.count_if(ok).alias("n_improved"), F.count("*").alias("n_flagged"))
