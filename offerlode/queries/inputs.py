"""Derived inputs of the registered queries; each is plain SQL over the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlode.operators import lines as L
from offerlode.plans.pages import cleaned_pages
from offerlode.sources.tables import offer_lines, spread, table

ID = "cast(page_id as varchar(19))"
_A = "cast(1 + page_id % 60 as varchar(19))"
_B = "cast(10 + page_id % 90 as varchar(19))"
_C = "cast(20 + page_id % 50 as varchar(19))"

# Offer lines that are put into the article of every page, and decoys that must go.
COUPON_LINE = f"concat({_A}, '% off gadget ', {ID}, ' with code GET', {_B}, 'X & more')"
DEAL_LINES = (
    COUPON_LINE,
    f"concat({_A}, '% off')",
    f"concat('gadget ', {ID}, ' with code GET', {_B}, 'X & more')",
    f"concat('Free shipping on orders $', {_C}, '+ | Members get 5% cash back ', {ID})",
    f"concat('Buy 2, Get 1 free on item ', {ID})",
)
DEAL_HTML = f"""replace(html, '</article>', concat(
  '<div class="coupon-item"><b>', {_A}, '% off</b> gadget ', {ID}, ' with code GET', {_B},
  'X &amp; more</div><section data-promo="1">Free shipping on orders $', {_C},
  '+ | Members get 5% cash back ', {ID}, '</section>',
  '<div class="deal" style="display: none">90% off hidden</div>',
  '<nav><p class="deal">75% off nav</p></nav><p>Buy 2, Get 1 free on item ', {ID},
  '</p></article>'))"""

# Strips of the coupon site: (title, raw type, badge, notes), and the type they must get.
STRIPS = (
    (f"concat({_A}, '% Off With $', {_C}, ' Candies Orders')", "coupon", "Code",
     ("Limited time", "Show Code"), "COUPON"),
    (f"concat(cast(1 + page_id % 9 as varchar(19)), '% Cash Back For Item ', {ID})", "",
     "Online Cash Back", ("Ends May 5, 2026",), "REWARD"),
    (f"concat('Free Shipping On $', {_C}, '+ Collection')", "sale", "Sale", ("Get Deal",),
     "SHIPPING"),
    (f"concat('Buy 1, Get 1 Free on item ', {ID})", "", "", ("Get Deal",), "BOGO"),
    (f"concat('Up to $', {_B}, ' off $', {_C}, ' exclusive')", "", "",
     ("Get Deal", "Expiring soon"), "SALE"),
    (f"concat('Clearance of item ', {ID})", "sale", "", ("Sitewide",), "sale"),
    ("'How can I reach the shop?'", "", "", ("Get Deal",), "SALE"),
)


def _strip_html(title: str, raw: str, badge: str, notes: tuple[str, ...]) -> str:
    data = f""" x-data="{{''offerType'': ''{raw}''}}\"""" if raw else ""
    span = f"<span>{badge}</span>" if badge else ""
    divs = "".join(f"<div>{note}</div>" for note in notes)
    return (f"'<a data-component-class=\"offer_strip\"{data}>{span}<h3>', {title}, "
            f"'</h3>{divs}</a>'")


# The coupon site's heading and strips, put into every page's own html.
SITE_HTML = (
    f"replace(replace(html, '<article>', concat('<h1>Shop ', {ID}, ' Coupons &amp; Promo Codes</h1><article>')), "
    "'</article>', concat('<div>', " + ", ".join(_strip_html(*strip[:4]) for strip in STRIPS) + ", '</div></article>'))")
SITE_URL = f"concat('https://www.RetailMeNot.com/view/', {ID})"

# URLs as people type them: half of them need work, some are unusable.
TYPED_URL = """case page_id % 8
  when 0 then concat('  ', url, ' ')
  when 1 then regexp_replace(url, '^https?://', '')
  when 2 then regexp_replace(url, '^http', 'ftp')
  when 3 then '   '
  when 4 then concat('https:///', cast(page_id as varchar(19)))
  when 5 then concat('HTTPS://WWW.Shop', cast(page_id as varchar(19)), '.example.com:8080/Store/o''neil-x_y.html;v=1?b=2#c')
  when 6 then concat('https://55haitao.com/store/michael-kors', cast(page_id as varchar(19)), '.html')
  else url end"""
ROUTED_URL = f"case when page_id % 4 = 0 then {SITE_URL} when page_id % 4 = 1 " \
    f"then 'retailmenot.com/view/x' else url end"


# Pages of a batch: some came back blank, some lose their root, the rest hold offers.
LOST_ROOT = f"concat('<html class=\"navbar\"><body>', {ID}, '% off</body></html>')"
BATCH_HTML = f"case page_id % 16 when 5 then '  ' when 15 then {LOST_ROOT} else {DEAL_HTML} end"


def pages(spark: SparkSession, folder: str, **columns: str) -> DataFrame:
    """The page table with extra SQL columns, dealt out to all cores when it is small."""
    base = spread(table(spark, folder, "pages").select("page_id", "url", "html"))
    return base.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def deal_pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder, html=DEAL_HTML)


def cleaned_deal_pages(spark: SparkSession, folder: str) -> DataFrame:
    return cleaned_pages(deal_pages(spark, folder))


def gated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned, split and filtered offer lines with ``offer`` and ``fold``."""
    return L.offer_lines(L.explode_parts(offer_lines(spark, folder)))


def supplier_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of the derived lines: one per supplier."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("title"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a fallback model for some pages, failures for others."""
    return supplier_pages(spark, folder).select(
        "page_id",
        F.expr("case when page_id % 4 = 0 then concat(title, ' | 5% off | NO_CODE | none') "
               "end").alias("response_text"),
        F.expr("case when page_id % 4 = 1 then 'quota exceeded' end").alias("response_error"))


# The fetch log of the derived pages: a visitor's errors are retries of the page with that
# number, and the last event tells how it ended.
FETCH_SQL = """select s_suppkey as page_id, 1 + count(case when event_type = 'error' then 1 end) as attempts,
  case when {last}(event_type, event_id) = 'error' then 'timeout' end as error
from supplier left join events on user_id = s_suppkey group by s_suppkey"""


def fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    sql = FETCH_SQL.format(last="max_by").replace("from supplier left join events", "from {supplier} left join {events}")
    return spark.sql(sql, supplier=table(spark, folder, "supplier"), events=table(spark, folder, "events"))
