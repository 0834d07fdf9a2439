"""Registered queries: name -> (Spark plan, the same result as DuckDB SQL or None)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlode.functions import text as X
from offerlode.functions import urls as U
from offerlode.functions import values as V
from offerlode.functions.tokenizer import VOID
from offerlode.operators import batch, dom, report
from offerlode.operators import lines as L
from offerlode.operators.custom import custom_extractor
from offerlode.operators.dedup import (
    deduplicate, distinct_offers, rank_and_filter, top_offers,
)
from offerlode.operators.routing import extract_all, route
from offerlode.operators.signals import with_expiry, with_folded, with_min_spend, with_signals
from offerlode.operators.site_rules import with_site_fields
from offerlode.plans.offers import fixture_candidates, fixture_offers, ranked_fixture_offers
from offerlode.plans.pages import (
    cleaned_pages, default_routes, generic_candidates, text_candidates,
)
from offerlode.queries import inputs as I
from offerlode.queries import sql as Q
from offerlode.sinks import render
from offerlode.sources.pages import decode_body, page_contents, page_error, page_records
from offerlode.sources.tables import offer_lines, spread, table
from offerlode.sources.url_lists import url_list

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GATE = 0.89  # fallback threshold of the gate queries; the derived pages score high


def query(name: str, sql: str | None = None):
    def add(plan: Query) -> Query:
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return add


def joined(column: str):
    return F.concat_ws(",", column).alias(column)


# --- sources ----------------------------------------------------------------------

_URLS = f"typed as (select page_id, {I.TYPED_URL} as url from pages)"


@query("src_url_list", f"""with {_URLS}
select cast(page_id + 2 as bigint) as row_number, trim(url) as url from typed
where trim(url) <> ''""")
def src_url_list(spark, folder):
    """Numbered by the file: its rows are in page_id order from 0, and the first is number 2."""
    return url_list(table(spark, folder, "pages").select(F.expr(I.TYPED_URL).alias(" Page-URL ")))


@query("url_looks_like", f"""with {_URLS}, full_urls as (
  select page_id, trim(url) as u, case when contains(trim(url), '://') then trim(url)
    else 'https://' || trim(url) end as f from typed)
select page_id, (u <> '' and regexp_matches(f, '^https?://[^/?#]', 'i')) as looks_like_url
from full_urls""")
def url_looks_like(spark, folder):
    return I.pages(spark, folder, url=I.TYPED_URL).select(
        "page_id", U.looks_like_url(F.col("url")).alias("looks_like_url"))


_TITLE = "replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '&quot;', '\"')"


@query("src_pages", f"""select page_id, url as requested_url, url as final_url,
  {_TITLE} as title, length(html) as html_size, cast(null as integer) as status_code,
  cast(null as integer) as elapsed_ms from pages""")
def src_pages(spark, folder):
    return page_records(I.pages(spark, folder)).select(
        "page_id", "requested_url", "final_url", "title",
        F.length("raw_html").cast("bigint").alias("html_size"), "status_code", "elapsed_ms")


@query("src_title", f"select page_id, {_TITLE} as title from pages")
def src_title(spark, folder):
    return I.pages(spark, folder).select("page_id", X.page_title(F.col("html")).alias("title"))


@query("src_text_lines", """select doc_id, cast(i as integer) as line_no, parts[i + 1] as line
from (select doc_id, parts, unnest(range(len(parts))) as i
      from (select doc_id, string_split_regex(text, '\\r\\n|[\\n\\v\\f\\r]') as parts from documents))
where trim(parts[i + 1]) <> ''""")
def src_text_lines(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return L.explode_text(docs).where(F.btrim("line") != "")


# --- URLs -------------------------------------------------------------------------

@query("url_normalize", f"""with {_URLS}, stripped as (
  select page_id, trim(url) as u,
    lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as s from typed),
full_urls as (select page_id, u, case when s = '' then 'https://' || u else u end as f,
  case when s = '' then 'https' else s end as s from stripped)
select page_id, f as url, case when u = '' then '{V.URL_EMPTY}'
  when s not in ('http', 'https') then '{V.URL_BAD_SCHEME}'
  when regexp_extract(f, '^[^:]+://([^/?#]*)', 1) = '' then '{V.URL_NO_DOMAIN}' end as error
from full_urls""")
def url_normalize(spark, folder):
    typed = I.pages(spark, folder, url=I.TYPED_URL)
    return typed.select("page_id", U.normalized_url(F.col("url")).alias("url"),
                        U.url_error(F.col("url")).alias("error"))


_FULL = """full_urls as (
  select page_id, url, case when contains(url, '://') then url else 'https://' || url end as f
  from typed),
split_urls as (
  select page_id, url, lower(regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host,
    regexp_replace(regexp_extract(f, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') as path,
    regexp_extract(f, '^[^?#]*\\?([^#]*)', 1) as query
  from full_urls)"""
_STRIPPED = f"typed as (select page_id, trim(url) as url from (select page_id, {I.TYPED_URL} as url from pages))"


@query("url_domain", f"with {_STRIPPED}, {_FULL} select page_id, host as domain from split_urls")
def url_domain(spark, folder):
    typed = I.pages(spark, folder, url=f"trim({I.TYPED_URL})")
    return typed.select("page_id", U.domain(F.col("url")).alias("domain"))


@query("url_output_stem", f"""with {_STRIPPED}, {_FULL}, sources as (
  select page_id, url, host || path || case when query <> '' then '_' || query else '' end as s
  from split_urls),
slugs as (select page_id, trim(regexp_replace(lower(
  case when trim(s, '_/') = '' then url else s end), '[^a-z0-9]+', '_', 'g'), '_') as slug from sources)
select page_id, printf('row_%05d_', page_id) ||
  substr(case when slug = '' then 'url' else slug end, 1, 80) as output_stem from slugs""")
def url_output_stem(spark, folder):
    typed = I.pages(spark, folder, url=I.TYPED_URL)
    return typed.select(
        "page_id", U.output_stem(F.col("page_id"), F.col("url")).alias("output_stem"))


def _sql_title(column: str) -> str:
    runs = f"regexp_extract_all({column}, '[A-Za-z]+|[^A-Za-z]+')"
    return (f"array_to_string(list_transform({runs}, lambda r: upper(substr(r, 1, 1)) || "
            "lower(substr(r, 2))), '')")


_SLUGS = ", ".join(
    f"nullif(regexp_extract(trim(path, '/'), '{prefix}([^/.]*)', 1), '')"
    for prefix in V.STORE_PATH_PREFIXES)


@query("url_store", f"""with {_STRIPPED}, {_FULL}, named as (
  select page_id, host, replace(replace(coalesce({_SLUGS}), '-', ' '), '_', ' ') as slug,
    split_part(replace(host, 'www.', ''), '.', 1) as label from split_urls)
select page_id, case when slug is not null then {_sql_title('slug')}
  when replace(host, 'www.', '') <> '' then {_sql_title('label')}
  else '{V.UNKNOWN_STORE}' end as store from named""")
def url_store(spark, folder):
    typed = I.pages(spark, folder, url=f"trim({I.TYPED_URL})")
    return typed.select("page_id", U.store_from_url(F.col("url")).alias("store"))


# --- HTML -------------------------------------------------------------------------

def _sql_decode(column: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        column = f"replace({column}, '&{name};', '{char}')"
    return column


_BODY = (
    "regexp_replace(html, '<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|"
    "<div class=\"deal\".*?</div>|<!--.*?-->', '', 'gs')")


@query("html_clean_nodes", f"""with bodies as (select page_id, {_BODY.replace('html,', I.DEAL_HTML + ',')} as b from pages)
select page_id, text from (select page_id, trim({_sql_decode('unnest(string_split_regex(b, %s))' % "'<[^>]*>'")}) as text
from bodies) where text <> ''""")
def html_clean_nodes(spark, folder):
    kept = I.cleaned_deal_pages(spark, folder)
    return dom.text_nodes(kept, "page_id").select("page_id", "text")


_BLOCKED = "regexp_replace(b, '<(br|/?(p|h1|div|section|article|body|html)[^>]*)>', chr(10), 'g')"


@query("html_to_text", f"""with bodies as (select page_id, replace({_BODY.replace('html,', I.DEAL_HTML + ',')}, chr(10), ' ') as b from pages),
blocks as (select page_id, {_sql_decode(f"regexp_replace({_BLOCKED}, '<[^>]*>', '', 'g')")} as t from bodies)
select page_id, line from (select page_id, trim(regexp_replace(unnest(string_split(t, chr(10))), '\\s+', ' ', 'g')) as line
from blocks) where line <> ''""")
def html_to_text(spark, folder):
    kept = I.cleaned_deal_pages(spark, folder)
    text = kept.select("page_id", dom.cleaned_text().alias("text"))
    return L.explode_text(text).where(F.col("line") != "").select("page_id", "line")


_VOID = ", ".join(f"'{tag}'" for tag in sorted(VOID))
# Start tags and texts of the cleaned body, and the length that its end tags add to it.
_CLEANED = f"""bodies as (select page_id, {_BODY.replace('html,', I.DEAL_HTML + ',')} as b from pages),
opened as (select page_id, trim({_sql_decode("regexp_replace(regexp_extract(b, '(?s)<body>.*'), '</[^>]*>', '', 'g')")}) as open_html,
  list_sum(list_transform(list_filter(regexp_extract_all(regexp_extract(b, '(?s)<body>.*'), '<([a-z0-9]+)', 1),
    lambda t: t not in ({_VOID})), lambda t: length(t) + 3)) as end_chars,
  {_sql_decode(f"regexp_replace({_BLOCKED.replace('b,', 'replace(b, chr(10), chr(32)),')}, '<[^>]*>', '', 'g')")} as t from bodies),
cleaned as (select page_id, open_html, length(open_html) + end_chars as html_size, array_to_string(list_filter(list_transform(
  string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) as cleaned_text from opened)"""


@query("page_record", f"""with {_CLEANED} select p.page_id, url as requested_url, url as final_url, {_TITLE} as title, raw_chars, open_html as cleaned_html_open, html_size as cleaned_html_chars, cleaned_text,
  cast(null as integer) as status_code, cast(null as integer) as elapsed_ms
from (select *, length({I.DEAL_HTML}) as raw_chars from pages) p join cleaned c on p.page_id = c.page_id""")
def page_record(spark, folder):
    """All eight fields; of the cleaned HTML its length, and the whole of it but for end tags."""
    found = page_contents(I.deal_pages(spark, folder))
    return found.select(
        "page_id", "requested_url", "final_url", "title",
        F.length("raw_html").cast("bigint").alias("raw_chars"),
        F.trim(F.regexp_replace("cleaned_html", "</[^>]*>", "")).alias("cleaned_html_open"),
        F.length("cleaned_html").cast("bigint").alias("cleaned_html_chars"), "cleaned_text",
        "status_code", "elapsed_ms")


_ENCODINGS = "case page_id % 5 when 0 then 'utf-8' when 1 then 'latin-1' when 2 then 'no-such-set' when 3 then 'UTF8' end"


@query("body_decode", f"""select page_id, case when page_id % 5 = 1 then 'caf' || chr(195) || chr(169) || ' ' || substr(url, 1, 40)
  else 'café ' || substr(url, 1, 40) || case when page_id % 2 = 0 then chr(65533) || '.' else '' end end as text from pages""")
def body_decode(spark, folder):
    body = F.concat(
        F.encode(F.concat(F.lit("café "), F.substring("url", 1, 40)), "UTF-8"),
        F.when((F.col("page_id") % 2 == 0) & (F.col("page_id") % 5 != 1), F.unhex(F.lit("FF2E"))).otherwise(F.unhex(F.lit(""))))
    return I.pages(spark, folder).select(
        "page_id", decode_body(body, F.expr(_ENCODINGS)).alias("text"))


_PARTLY_EMPTY = """case page_id % 10 when 0 then '  ' when 1 then
  concat('<html class="navbar">', html, '</html>') when 2 then '<body></body>' else html end"""


@query("html_empty_pages", f"""select page_id, case when page_id % 8 in (2) then '{V.URL_BAD_SCHEME}'
  when page_id % 8 = 3 then '{V.URL_EMPTY}' when page_id % 8 = 4 then '{V.URL_NO_DOMAIN}'
  when page_id % 10 = 0 then '{V.EMPTY_PAGE_PREFIX}' || case when page_id % 8 = 1 then 'https://' else '' end
    || trim({I.TYPED_URL}) || '.' end as error
from pages""")
def html_empty_pages(spark, folder):
    pages = I.pages(spark, folder, html=_PARTLY_EMPTY, url=I.TYPED_URL)
    kept = dom.tokenize(pages)
    return kept.select("page_id", page_error(
        F.col("url"), F.col("root_dropped"), F.col("html"), F.col("error")).alias("error"))


# --- lines ------------------------------------------------------------------------

@query("line_normalize", f"""with {Q.LINES} select line_id, {Q.plain('line')} as plain,
  {Q.normal('line')} as generic, trim({Q.collapse('line')}) as collapsed from lines""")
def line_normalize(spark, folder):
    packed = F.concat(
        F.regexp_replace("line", " ", "  "), F.lit("&nbsp;​"))
    lines = offer_lines(spark, folder).select(
        "line_id", X.normalize_plain(F.col("line")).alias("plain"), packed.alias("generic"),
        X.normalize_candidate_text(F.col("line")).alias("collapsed"))
    return X.normalize_generic(lines, "generic")


_CTA = "line || ' Verified 12 interested users, added by Bob-7 exclusive | get deal'"


@query("line_cta_strip", f"""with {Q.LINES}, noisy as (select line_id, {_CTA} as line from lines)
select line_id, {Q.clean('line')} as generic, {Q.clean_site('line')} as site from noisy""")
def line_cta_strip(spark, folder):
    noisy = offer_lines(spark, folder).select("line_id", F.expr(_CTA).alias("generic"))
    rows = noisy.withColumn("site", X.clean_site_offer(F.col("generic")))
    return X.clean_lines(rows, "generic").select("line_id", "generic", "site")


@query("line_split", f"with {Q.LINES}, {Q.parts()} select line_id, page_id, part_no, part from parts")
def line_split(spark, folder):
    return X.keep_rows(
        L.explode_parts(offer_lines(spark, folder)), F.col("part") != "",
        ("line_id", "page_id", "part_no"), ("part",))


@query("line_filter", f"""with {Q.LINES} select line_id, line,
  length(line) between {V.MIN_LINE_CHARS} and {V.MAX_LINE_CHARS} as fits,
  {Q.noise('line')} as noise, {Q.site_noise('line')} as site_noise from lines""")
def line_filter(spark, folder):
    line = F.col("line")
    return offer_lines(spark, folder).select(
        "line_id", "line", X.fits_line_length(line).alias("fits"),
        X.is_noise_line(line).alias("noise"), X.is_noise_site_offer(line).alias("site_noise"))


_TOKEN = "unnest(string_split(p_name || ' ' || upper(p_brand) || ' SAVE' || cast(p_size as varchar) || '. 2026-04-21 (' || cast(p_partkey as varchar) || ') checkout', ' '))"


@query("coupon_code_valid", f"""with tokens as (select p_partkey, {_TOKEN} as token from part)
select p_partkey, token, case when {Q.code_valid(Q.code_normal('token'))} then {Q.code_normal('token')} end as code
from tokens""")
def coupon_code_valid(spark, folder):
    tokens = table(spark, folder, "part").select("p_partkey", F.explode(F.expr(
        "split(concat(p_name, ' ', upper(p_brand), ' SAVE', p_size, '. 2026-04-21 (', "
        "p_partkey, ') checkout'), ' ')")).alias("token"))
    coded = tokens.withColumn("code", X.normalize_code(F.col("token")))
    return coded.withColumn("code", F.when(X.is_coupon_code(F.col("code")), F.col("code")))


# Headings of the page's own html, with what shops write around a name.
_OWN_H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"
_HEADINGS = f"""h as (select page_id,
  case page_id % 4 when 0 then 'Deals' when 1 then concat({_OWN_H1}, ' Coupons &amp; Promo Codes')
    when 2 then '  ' else concat({_OWN_H1}, ' (Paris)') end as h1,
  case page_id % 3 when 0 then 'Sales' when 1 then concat({_OWN_H1.replace('h1', 'title')}, ' Promo Code list') else url end as title,
  concat('Site ', cast(page_id as varchar(19))) as site from pages)"""


def _sql_heading(column: str) -> str:
    value = f"trim({Q.collapse(_sql_decode(column))}, {Q.text(V.STRIP_GENERIC)})"
    found = ", ".join(
        f"nullif(trim(regexp_extract({value}, {Q.text(p)}, 1, 'i')), '')" for p in V.STORE_SUFFIXES)
    heading = f"lower({value}) in ({Q.words(V.DEAL_HEADINGS)})"
    return (f"coalesce({found}, case when {value} <> '' and not {heading} "
            f"then substr({value}, 1, {V.STORE_CHARS}) end)")


@query("store_from_html", f"""with {_HEADINGS} select page_id,
  coalesce({_sql_heading('h1')}, {_sql_heading('title')}, {_sql_heading('site')}) as store,
  nullif(trim(regexp_extract({Q.plain(_sql_decode("h1"))}, {Q.text(V.SITE_STORE_HEADING)}, 1, 'i')), '') as site_store
from h""")
def store_from_html(spark, folder):
    body = _HEADINGS.split("select page_id,", 1)[1].rsplit(" from pages)", 1)[0]
    headings = I.pages(spark, folder).selectExpr("page_id", *_split_columns(body))
    decoded = headings.withColumn("h1", X.decode_entities(F.col("h1")))
    named = X.with_store_from_page(decoded, "store", "h1", "title", "site")
    return named.select(
        "page_id", "store", X.store_from_site_heading(F.col("h1")).alias("site_store"))


def _split_columns(body: str) -> list[str]:
    """The three heading expressions of the shared SQL, for ``selectExpr``."""
    first, rest = body.split(" as h1,", 1)
    second, third = rest.split(" as title,", 1)
    return [f"{first} as h1", f"{second} as title", third]


# --- detectors --------------------------------------------------------------------

_SIGNALS = f"{Q.GATED}, {Q.signals('offers')}"
_KEYS = "line_id, part_no, offer"


def _signal_query(name: str, columns: tuple[str, ...], where: str | None = None) -> None:
    condition = where or " or ".join(f"{column} is not null" for column in columns)

    def plan(spark, folder):
        rows = with_signals(I.gated_lines(spark, folder))
        return X.keep_rows(
            rows, F.expr(condition), ("line_id", "part_no"), ("offer", *columns))

    query(name, f"{_SIGNALS} select {_KEYS}, {', '.join(columns)} from fields "
                f"where {condition}")(plan)


_signal_query("sig_percent", ("p_direct", "p_upto", "p_extra"))
_signal_query("sig_amount", ("c_amount", "c_upto_amount", "c_save", "discount_amount",
                             "max_discount_amount", "discount_type"))
_signal_query("sig_cashback", ("c_cashback", "c_zh_cashback", "cashback_percent"))
_SHIPPING = ("m_shipping", "m_zh_shipping", "m_ko_shipping", "m_ja_shipping", "m_es_shipping")
_signal_query("sig_shipping", _SHIPPING, " or ".join(_SHIPPING))
_signal_query("sig_bogo", ("m_bogo", "m_zh_bogo"), "m_bogo or m_zh_bogo")
_signal_query("sig_code", (*Q.CODES, "coupon_code"))
_signal_query("sig_zh_discount", ("p_zh_extra", "p_zh_low", "p_zhe", "c_zh_min", "c_zh_minus"))
_signal_query("sig_intl_discount", ("p_korean", "p_japanese", "p_spanish"))
_signal_query("sig_strength", ("strong_signals", "weak_signals"), "strong_signals > 0")
_signal_query("offer_type_merge", ("offer_type", "n_sale", "n_shipping", "n_reward",
                                   "n_bogo", "n_code"), "offer_type is not null")


@query("min_spend", f"""{_SIGNALS} select {_KEYS}, {Q.MIN_SPEND} as min_spend from fields where strong_signals > 0""")
def min_spend(spark, folder):
    rows = X.keep_rows(
        with_signals(I.gated_lines(spark, folder)), F.col("strong_signals") > 0,
        ("line_id", "part_no"), ("offer", "fold", "c_zh_min"))
    return with_min_spend(rows).select("line_id", "part_no", "offer", "min_spend")


@query("expiry", f"""with {Q.LINES}, {Q.parts()} select line_id, part_no, part as offer,
  {Q.EXPIRY.replace('offer', 'part')} as expiry, {Q.EXPIRY_TYPE.replace('offer', 'part')} as expiry_type
from parts""")
def expiry(spark, folder):
    parts = L.explode_parts(offer_lines(spark, folder)).withColumnRenamed("part", "offer")
    dated = with_expiry(with_folded(parts))
    return X.keep_rows(dated, F.col("offer") != "", ("line_id", "part_no"),
                       ("offer", "expiry", "expiry_type"))


# --- scores and candidates --------------------------------------------------------

_FIELDS = ("store", "offer", "source", "offer_type", "coupon_code", "discount_percent",
           "discount_amount", "max_discount_amount", "cashback_percent", "min_spend",
           "discount_type", "expiry", "expiry_type", "confidence")
_SQL_FIELDS = ", ".join(_FIELDS)


@query("score", f"{Q.CANDIDATES} select page_id, {_SQL_FIELDS} from cand")
def score(spark, folder):
    return fixture_candidates(spark, folder).select("page_id", *_FIELDS)


@query("score_reasons", f"{Q.CANDIDATES} select page_id, offer, confidence, reasons from cand")
def score_reasons(spark, folder):
    return fixture_candidates(spark, folder).select(
        "page_id", "offer", "confidence", joined("reasons"))


_DOM_LINES = ", ".join(f"struct_pack(n := {n}, line := {line})" for n, line in enumerate(I.DEAL_LINES))
_H1 = f"regexp_extract(html, '<h1>(.*?)</h1>', 1)"
_H1_STORE = f"substr(trim({Q.collapse(_sql_decode(_H1))}, {Q.text(V.STRIP_GENERIC)}), 1, {V.STORE_CHARS})"
_PAGE_LINES = f"""lines as (select page_id, store, cast(r.n as bigint) as line_id, r.line as line
  from (select page_id, {_H1_STORE} as store, unnest([{_DOM_LINES}]) as r from pages))"""
_PAGE_CAND = f"""with {_PAGE_LINES}, {Q.parts(keys='line_id, page_id, store')},
firsts as (select page_id, store, offer, cast(0 as bigint) as ord_hi, min(line_id * 1024 + part_no) as ord_lo
  from offers group by page_id, store, offer), {Q.candidates('firsts')}"""


@query("dom_containers", f"""with texts as (select page_id, unnest([
  struct_pack(s := 0, o := 0, t := {I.DEAL_LINES[0]}), struct_pack(s := 0, o := 1, t := {I.DEAL_LINES[1]}),
  struct_pack(s := 0, o := 2, t := {I.DEAL_LINES[2]}), struct_pack(s := 13, o := 0, t := {I.DEAL_LINES[3]}),
  struct_pack(s := 13, o := 1, t := {I.DEAL_LINES[3]})]) as r from pages)
select page_id, cast(r.s as integer) as selector, cast(r.o as integer) as line_no, r.t as line,
  case when r.s = 0 then '<div class="coupon-item"><b>' else '<section data-promo="1">Free' end as opening
from texts""")
def dom_containers(spark, folder):
    kept = I.cleaned_deal_pages(spark, folder)
    found = dom.container_lines(kept, "page_id", html="html")
    return found.select(
        "page_id", F.shiftright("ord_hi", 32).cast("int").alias("selector"), "line_no", "line",
        F.substring("raw_html", 1, 28).alias("opening"))


@query("extract_generic", f"{_PAGE_CAND} select page_id, {_SQL_FIELDS}, reasons from cand")
def extract_generic(spark, folder):
    return generic_candidates(I.cleaned_deal_pages(spark, folder)).select(
        "page_id", *_FIELDS, joined("reasons"))


_DOC_URL = "concat('https://shop', cast(doc_id as varchar(19)), '.example.com/x')"
_TEXT_DOCS = f"concat(text, '\\nSave ', cast(1 + doc_id % 70 as varchar(19)), '% off with code DOC', cast(100 + doc_id % 800 as varchar(19)))"


@query("extract_text", f"""with lines as (select doc_id as page_id, cast(0 as bigint) as line_id,
  'Shop' || cast(doc_id as varchar) as store,
  'Save ' || cast(1 + doc_id % 70 as varchar) || '% off with code DOC' || cast(100 + doc_id % 800 as varchar) as line
  from documents), {Q.parts(keys='line_id, page_id, store')},
firsts as (select page_id, store, offer, cast(0 as bigint) as ord_hi, min(line_id) as ord_lo
  from offers group by page_id, store, offer), {Q.candidates('firsts')}
select page_id, {_SQL_FIELDS} from cand""")
def extract_text(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    pages = docs.select(F.col("doc_id").alias("page_id"), F.expr(_DOC_URL).alias("url"),
                        F.expr(_TEXT_DOCS).alias("text"))
    return text_candidates(pages).select("page_id", *_FIELDS)


def _sql_strip(number: int, strip) -> str:
    title, _, badge, notes, kind = strip
    cash = "Online Cash Back" in badge
    date = next((note.replace("Ends ", "") for note in notes if "2026" in note), None)
    relative = next((n for n in notes if n in ("Limited time", "Expiring soon")), None)
    expiry = date or relative
    return (
        f"struct_pack(n := {number}, title := {title}, kind := '{kind}', cash := {str(cash).lower()}, "
        f"expiry := {Q.text(expiry) if expiry else 'cast(null as varchar)'}, "
        f"et := {Q.text('date' if date else 'relative') if expiry else 'cast(null as varchar)'})")


_SITE_SPEND = (
    f"coalesce('$' || {Q.grab('offer', V.SITE_AMOUNT_OFF_MIN_SPEND)}, {Q.grab('offer', V.SITE_MIN_SPEND)})")
_SITE_CAND = f"""with strips as (select page_id, r.n as ord_lo, {Q.clean_site('r.title')} as offer,
  r.kind as offer_type, r.cash as cash, r.expiry as expiry, r.et as expiry_type
  from (select page_id, unnest([{', '.join(_sql_strip(n, s) for n, s in enumerate(I.STRIPS))}]) as r from pages)),
detailed as (select page_id, ord_lo, cast(0 as bigint) as ord_hi, offer, offer_type, expiry, expiry_type,
  'Shop ' || cast(page_id as varchar) as store, '{V.SITE}' as source, cast(null as varchar) as coupon_code,
  {Q.number('offer', V.PERCENT_OFF)} as discount_percent,
  case when {Q.hit('offer', V.UP_TO_AMOUNT_OFF)} then null else {Q.grab('offer', V.AMOUNT_OFF)} end as discount_amount,
  {Q.grab('offer', V.UP_TO_AMOUNT_OFF)} as max_discount_amount,
  case when cash then {Q.number('offer', V.CASHBACK)} end as cashback_percent,
  {_SITE_SPEND} as min_spend,
  case when {Q.hit('offer', V.UP_TO_AMOUNT_OFF)} then 'upto' end as discount_type,
  offer as normalized_line
  from strips where offer <> '' and not {Q.site_noise('offer')}),
cand as (select * from (select *, {Q.score()} as confidence, {Q.reasons()} as reasons from detailed)
  where confidence >= cast(0.4 as double)), {Q.deduplicated()}"""


def _site_pages(spark, folder):
    return I.pages(spark, folder, url=I.SITE_URL, html=I.SITE_HTML)


@query("extract_site", f"{_SITE_CAND} select page_id, {_SQL_FIELDS}, reasons from deduped")
def extract_site(spark, folder):
    routes = default_routes()
    candidates = routes.extractors[V.SITE](cleaned_pages(_site_pages(spark, folder)))
    return candidates.select("page_id", *_FIELDS, joined("reasons"))


@query("site_fields", f"""with {Q.LINES}, offers as (select line_id, line as offer from lines)
select line_id, offer, {Q.number('offer', V.PERCENT_OFF)} as discount_percent,
  case when {Q.hit('offer', V.UP_TO_AMOUNT_OFF)} then null else {Q.grab('offer', V.AMOUNT_OFF)} end as discount_amount,
  {Q.grab('offer', V.UP_TO_AMOUNT_OFF)} as max_discount_amount, {_SITE_SPEND} as min_spend,
  case when {Q.hit('offer', V.UP_TO_AMOUNT_OFF)} then 'upto' end as discount_type from offers""")
def site_fields(spark, folder):
    lines = offer_lines(spark, folder).select("line_id", F.col("line").alias("offer"))
    return with_site_fields(lines).select(
        "line_id", "offer", "discount_percent", "discount_amount", "max_discount_amount",
        "min_spend", "discount_type")


@query("route_pages", f"""with typed as (select page_id, {I.ROUTED_URL} as url from pages), {_FULL}
select page_id, host as domain, case when host in ({Q.words(V.SITE_DOMAINS)}) then '{V.SITE}'
  else '{V.GENERIC}' end as extractor from split_urls""")
def route_pages(spark, folder):
    return route(I.pages(spark, folder, url=I.ROUTED_URL), default_routes()).select(
        "page_id", "domain", "extractor")


@query("extract_routed", f"""select * from ({_SITE_CAND} select page_id, {_SQL_FIELDS} from deduped where page_id % 4 < 2)
union all select * from ({_PAGE_CAND} select page_id, {_SQL_FIELDS} from cand where page_id % 4 >= 2)""")
def extract_routed(spark, folder):
    mixed = I.pages(
        spark, folder, url=I.ROUTED_URL,
        html=f"case when page_id % 4 < 2 then {I.SITE_HTML} else {I.DEAL_HTML} end")
    routes = default_routes()
    return extract_all(route(mixed, routes), routes, cleaned_pages).select("page_id", *_FIELDS)


# --- deduplication and ranking ----------------------------------------------------

@query("dedup_pass", f"""{Q.CANDIDATES} select page_id, offer, confidence from cand
qualify row_number() over (partition by page_id, {Q.text_key()} order by ord_hi, ord_lo, offer) = 1""")
def dedup_pass(spark, folder):
    return distinct_offers(fixture_candidates(spark, folder)).select(
        "page_id", "offer", "confidence")


@query("dedup_canonical", f"{Q.OFFERS} select page_id, offer, confidence, offer_type from deduped")
def dedup_canonical(spark, folder):
    return deduplicate(fixture_candidates(spark, folder)).select(
        "page_id", "offer", "confidence", "offer_type")


@query("rank_filter", f"{Q.OFFERS} select page_id, rank, {_SQL_FIELDS} from ranked")
def rank_filter(spark, folder):
    return ranked_fixture_offers(spark, folder)[1].select("page_id", "rank", *_FIELDS)


@query("rank_capped", f"{Q.OFFERS} select page_id, offer, confidence from ranked where rank <= 25")
def rank_capped(spark, folder):
    return rank_and_filter(deduplicate(fixture_candidates(spark, folder)), max_results=25).select(
        "page_id", "offer", "confidence")


@query("top_offer", f"{Q.OFFERS} select page_id, offer as top_offer, offer_type as top_offer_type from ranked where rank = 1")
def top_offer(spark, folder):
    return top_offers(fixture_offers(spark, folder)).select(
        "page_id", F.col("offer").alias("top_offer"), F.col("offer_type").alias("top_offer_type"))


@query("preview10", f"{Q.OFFERS} select page_id, rank, {Q.OUTPUT_LINE} as line from ranked where rank <= 10")
def preview10(spark, folder):
    return top_offers(fixture_offers(spark, folder), V.PREVIEW, "rank").select(
        "page_id", F.col("rank").cast("bigint").alias("rank"), render.output_line().alias("line"))


# --- page results -----------------------------------------------------------------

def _summaries(spark, folder, offers):
    return report.page_summaries(I.supplier_pages(spark, folder).select("page_id"), offers)


@query("page_counts", f"{Q.REPORTS} select page_id, candidate_count from summaries")
def page_counts(spark, folder):
    return report.page_counts(I.supplier_pages(spark, folder), fixture_offers(spark, folder))


@query("page_confidence", f"{Q.REPORTS} select page_id, overall_confidence from summaries where candidate_count > 0")
def page_confidence(spark, folder):
    return report.page_confidence(fixture_offers(spark, folder))


@query("page_report", f"""{Q.REPORTS}, chunks as (
  select page_id, (rank - 1) // {report.REPORT_CHUNK} as chunk, count(*) as n,
    string_agg(offer, chr(10) order by rank) as offers from ranked group by 1, 2)
select s.page_id, candidate_count, overall_confidence, cast(coalesce(chunk, 0) as bigint) as chunk,
  cast(coalesce(n, 0) as bigint) as listed, coalesce(offers, '') as offers
from summaries s left join chunks c on s.page_id = c.page_id""")
def page_report(spark, folder):
    offers, ranked = ranked_fixture_offers(spark, folder)
    reports = report.page_reports(_summaries(spark, folder, offers), ranked)
    return reports.select(
        "page_id", "candidate_count", "overall_confidence", "chunk",
        F.size("candidates").cast("bigint").alias("listed"),
        F.array_join(F.transform("candidates", lambda c: c["offer"]), "\n").alias("offers"))


_PROMPTED = "'Offers of ' || s_name || chr(10) || 'page ' || cast(s_suppkey as varchar)"


@query("fallback_gate", f"""{Q.REPORTS} select page_id, overall_confidence,
  {Q.text(V.FALLBACK_PROMPT_PREFIX)} || {_PROMPTED} as prompt_text
from summaries join supplier on page_id = s_suppkey where overall_confidence < {GATE}""")
def fallback_gate(spark, folder):
    pages = I.supplier_pages(spark, folder).select("page_id", F.concat(
        F.lit(" Offers of "), "title", F.lit("\npage "), F.col("page_id").cast("string"),
        F.lit("\n")).alias("cleaned_text"))
    offers = fixture_offers(spark, folder)
    return report.fallback_prompts(report.page_summaries(pages, offers), threshold=GATE)


_ENRICHED = f"""{Q.REPORTS}, enriched as (select s.*,
  case when overall_confidence < {GATE} and page_id % 4 = 0 then s_name || ' | 5% off | NO_CODE | none' end as fallback_response_text,
  case when overall_confidence < {GATE} and page_id % 4 = 1 then 'quota exceeded' end as fallback_error
  from summaries s join supplier on page_id = s_suppkey)"""


@query("fallback_enrich", f"""{_ENRICHED} select page_id, candidate_count, overall_confidence,
  fallback_response_text is not null as used_llm_fallback, fallback_response_text, fallback_error from enriched""")
def fallback_enrich(spark, folder):
    offers = fixture_offers(spark, folder)
    return report.with_fallback_results(
        _summaries(spark, folder, offers), I.responses(spark, folder), GATE)


@query("run_metrics", f"""{Q.CANDIDATES}, {Q.deduplicated()},
log as ({I.FETCH_SQL.format(last='arg_max')}),
fetched as (select count(*) as urls_processed, count(*) filter (error is null) as urls_succeeded,
  count(*) filter (error is not null) as urls_failed, cast(sum(attempts - 1) as bigint) as total_retries from log),
totals as (select (select count(*) from (select distinct page_id, {Q.text_key()} from cand)) as extracted,
  (select count(*) from deduped) as after_dedup,
  (select sum(cast(round(confidence * 100) as bigint)) from kept) as hundredths, (select count(*) from kept) as retained)
select urls_processed, urls_succeeded, urls_failed, total_retries,
  cast(printf('%.2f', total_retries / urls_processed) as double) as retry_rate,
  extracted as total_candidates_extracted, after_dedup as total_after_dedup,
  cast(printf('%.1f', (extracted - after_dedup) / extracted * 100) as double) as dedup_reduction_pct,
  cast(printf('%.3f', cast(hundredths as double) / retained / 100) as double) as avg_confidence from fetched, totals""")
def run_metrics(spark, folder):
    return report.run_metrics(I.fetch_log(spark, folder), fixture_candidates(spark, folder))


_STEM = f"""stems as (select page_id, printf('row_%05d_', page_id + 2) ||
  substr(case when slug = '' then 'url' else slug end, 1, 80) as stem from (select page_id, trim(regexp_replace(lower(
  case when trim(s, '_/') = '' then url else s end), '[^a-z0-9]+', '_', 'g'), '_') as slug from (
  select page_id, url, host || path || case when query <> '' then '_' || query else '' end as s from split_urls)))"""
_BATCH_SQL = f"""{_PAGE_CAND.replace("from pages))", "from pages where page_id % 16 not in (5, 15)))")}, {Q.deduplicated()},
page_scores as (select page_id, count(*) as n, {Q.mean_confidence(
    f"cast(sum(case when rank <= 5 then cast(confidence * cast({Q.UNITS} as double) as bigint) end) as double)",
    "count(case when rank <= 5 then 1 end)")} as overall from ranked group by page_id),
{_STRIPPED}, {_FULL}, {_STEM},
flagged as (select p.page_id, p.page_id + 2 as row_number, {I.TYPED_URL} as requested_url, p.url as final_url,
  {_TITLE} as title, case when p.page_id % 8 = 2 then '{V.URL_BAD_SCHEME}' when p.page_id % 8 = 3 then '{V.URL_EMPTY}'
  when p.page_id % 8 = 4 then '{V.URL_NO_DOMAIN}' when p.page_id % 16 in (5, 15) then '{V.EMPTY_PAGE_PREFIX}' || trim({I.TYPED_URL}) || '.'
  end as error from pages p),
summary as (select f.page_id, f.row_number, f.requested_url, case when error is null then 'ok' else 'error' end as status,
  case when error is null then final_url else '' end as final_url,
  case when error is null then title else '' end as title, '' as status_code, '' as elapsed_ms,
  case when error is null then printf('%.2f', overall) else '' end as overall_confidence,
  cast(case when error is null then n else 0 end as varchar) as candidate_count, 'no' as used_llm_fallback, '' as fallback_error,
  case when error is null then r.offer else '' end as top_offer,
  case when error is null then r.offer_type else '' end as top_offer_type,
  case when error is null then 'output/html/' || stem || '.html' else '' end as html_path,
  case when error is null then 'output/text/' || stem || '.txt' else '' end as text_path,
  case when error is null then 'output/deals/' || stem || '.json' else '' end as deals_path, coalesce(error, '') as error
  from flagged f left join page_scores s on f.page_id = s.page_id join stems on f.page_id = stems.page_id
  left join (select page_id, offer, offer_type from ranked where rank = 1) r on f.page_id = r.page_id)"""


def _batch(spark, folder, contents=False):
    # Pages with bad URLs are never fetched, so none of them is tokenised.
    pages = I.pages(spark, folder, requested_url=I.TYPED_URL, html=I.BATCH_HTML)
    fetched = pages.where(U.url_error(F.col("requested_url")).isNull())
    urls = I.pages(spark, folder).select(
        (F.col("page_id") + 2).alias("row_number"), F.expr(I.TYPED_URL).alias("requested_url"),
        "page_id", F.col("url").alias("final_url"))
    return urls, batch.run_batch(fetched, default_routes(), contents)


@query("batch_summary", f"""{_BATCH_SQL} select cast(row_number as varchar) as row_number,
  {', '.join(name for name in V.SUMMARY_FIELDS if name != 'row_number')} from summary""")
def batch_summary(spark, folder):
    return batch.summary_text(batch.summarize_batch(
        *_batch(spark, folder), extension="json", save_html=True))


@query("batch_totals", f"""{_BATCH_SQL} select count(*) as total, count(*) filter (status = 'ok') as succeeded,
  count(*) filter (status = 'error') as failed from summary""")
def batch_totals(spark, folder):
    return batch.batch_totals(batch.summarize_batch(*_batch(spark, folder)))


# --- output -----------------------------------------------------------------------

@query("render_line", f"{Q.OFFERS} select page_id, {Q.OUTPUT_LINE} as line from kept")
def render_line(spark, folder):
    return fixture_offers(spark, folder).select("page_id", render.output_line().alias("line"))


@query("render_record", f"""{Q.OFFERS} select page_id, {_SQL_FIELDS.replace('confidence', 'round(confidence, 3) as confidence')},
  reasons from kept""")
def render_record(spark, folder):
    return render.records(fixture_offers(spark, folder), "page_id").withColumn(
        "reasons", F.concat_ws(",", "reasons"))


@query("render_csv", f"""{Q.OFFERS} select page_id, {', '.join(
  f"coalesce(cast({'round(confidence, 3)' if name == 'confidence' else name} as varchar), '') as {name}" for name in V.CSV_FIELDS)} from kept""")
def render_csv(spark, folder):
    return render.csv_fields(fixture_offers(spark, folder), "page_id")


@query("render_text", f"""{_ENRICHED} select page_id, cast(0 as bigint) as seq,
  'OVERALL_CONFIDENCE=' || printf('%.2f', overall_confidence) || chr(10) || 'USED_LLM_FALLBACK=' ||
  case when fallback_response_text is null then 'no' else 'yes' end || chr(10) || 'HEURISTIC_CANDIDATES' ||
  case when candidate_count = 0 then chr(10) || '{V.NO_DEALS}' else '' end as text from enriched
union all select page_id, rank, {Q.OUTPUT_LINE} from ranked
union all select page_id, candidate_count + 1, case when fallback_response_text is not null
  then 'LLM_FALLBACK_OUTPUT' || chr(10) || fallback_response_text else 'LLM_FALLBACK_ERROR' || chr(10) || fallback_error end
from enriched where fallback_response_text is not null or fallback_error is not null""")
def render_text(spark, folder):
    offers, ranked = ranked_fixture_offers(spark, folder)
    enriched = report.with_fallback_results(
        _summaries(spark, folder, offers), I.responses(spark, folder), GATE)
    return render.text_report(enriched, ranked)


def _sql_json(name: str) -> str:
    if name == "reasons":
        value = """case when reasons = '' then '[]' else '[' || chr(10) || '        "' ||
          replace(reasons, ',', '",' || chr(10) || '        "') || '"' || chr(10) || '      ]' end"""
    elif name in ("confidence", "discount_percent", "cashback_percent"):
        inner = "round(confidence, 3)" if name == "confidence" else name
        value = f"coalesce(cast({inner} as varchar), 'null')"
    else:
        value = f"coalesce(cast(to_json({name}) as varchar), 'null')"
    return f"""'      "{name}": ' || {value}"""


_JSON_BODY = " || ',' || chr(10) || ".join(_sql_json(name) for name in V.RECORD_FIELDS)


@query("render_json", f"""{Q.REPORTS} select page_id, cast(0 as bigint) as seq,
  '{{' || chr(10) || '  "overall_confidence": ' || cast(overall_confidence as varchar) || ',' || chr(10) ||
  '  "used_llm_fallback": false,' || chr(10) || '  "candidate_count": ' || cast(candidate_count as varchar) || ',' ||
  case when candidate_count > 0 then chr(10) || '  "candidates": [' else '' end as text from summaries
union all select r.page_id, rank, '    {{' || chr(10) || {_JSON_BODY} || chr(10) ||
  case when rank < candidate_count then '    }},' else '    }}' end from ranked r join summaries s on r.page_id = s.page_id
union all select page_id, candidate_count + 1, case when candidate_count > 0 then '  ]' else '  "candidates": []' end
  || chr(10) || '}}' from summaries""")
def render_json(spark, folder):
    offers, ranked = ranked_fixture_offers(spark, folder)
    return render.json_report(_summaries(spark, folder, offers), ranked)


@query("parse_lines", f"""{Q.OFFERS} select page_id, store, offer, coalesce(coupon_code, offer_type, 'NO_CODE') as code,
  split_part({Q.OUTPUT_LINE}, ' | ', 4) as conditions from kept""")
def parse_lines(spark, folder):
    lines = fixture_offers(spark, folder).select("page_id", render.output_line().alias("text"))
    return render.parse_output_lines(lines)


@query("run_summary", f"""{_BATCH_SQL}, {_CLEANED.replace("cleaned as", "cleaned_pages as")}
select s.page_id, requested_url, final_url, coalesce(nullif(title, ''), '{V.NO_TITLE}') as title,
  cast(null as integer) as status_code, html_size, length(cleaned_text) as text_size, cast(null as integer) as elapsed_ms,
  coalesce(p.overall, 0.0) as heuristic_confidence, false as llm_fallback, cast(coalesce(p.n, 0) as bigint) as candidates
from summary s join cleaned_pages c on s.page_id = c.page_id left join page_scores p on s.page_id = p.page_id where status = 'ok'""")
def run_summary(spark, folder):
    return batch.run_summary(*_batch(spark, folder, contents=True))


@query("custom_extractor", f"""select page_id, 'item ' || cast(page_id as varchar) as store,
  {I.DEAL_LINES[4]} as offer, 'house_rules' as source, 'BOGO' as offer_type,
  cast(0.3 as double) + cast(0.18 as double) + cast(0.14 as double) + cast(0.05 as double) as confidence from pages""")
def custom_extractor_query(spark, folder):
    def rule(kept):
        nodes = dom.text_nodes(kept, "page_id").where(F.col("text").startswith("Buy 2"))
        return nodes.select(
            "page_id", F.col("text").alias("offer"), F.lit("BOGO").alias("offer_type"),
            F.regexp_extract("text", "(item [0-9]+)", 1).alias("store"))

    routes = default_routes().register(
        "house_rules", (), custom_extractor("house_rules", rule))
    kept = I.cleaned_deal_pages(spark, folder)
    return routes.extractors["house_rules"](kept).select(
        "page_id", "store", "offer", "source", "offer_type", "confidence")
