"""The offer rules as DuckDB SQL, for checking the Spark plans against.

Built from the same fixed values; every CTE below mirrors one plan stage.
"""

from offerlode.functions import values as V
from offerlode.plans.fixture_lines import LINES_SQL


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, {text(word)})" for word in words) + ")"


def starts(column: str, words) -> str:
    return "(" + " or ".join(f"starts_with({column}, {text(word)})" for word in words) + ")"


def words(values) -> str:
    return ", ".join(text(value) for value in values)


def grab(column: str, pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract({column}, {text(pattern)}, {group}, '{flags}'), '')"


def number(column: str, pattern: str) -> str:
    return f"try_cast({grab(column, pattern)} as double)"


def hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {text(pattern)}, 'i')"


def collapse(column: str) -> str:
    return f"regexp_replace({column}, '\\s+', ' ', 'g')"


def plain(column: str) -> str:
    return f"trim({collapse(column)}, {text(V.STRIP_PLAIN)})"


def normal(column: str) -> str:
    return f"trim({collapse(column)}, {text(V.STRIP_GENERIC)})"


def remove(column: str, pattern: str) -> str:
    return f"regexp_replace({column}, {text(pattern)}, '', 'gi')"


def phrases(values) -> str:
    return r"\b(" + "|".join(values) + r")\b"


def clean(column: str) -> str:
    bare = remove(normal(column), phrases(V.CTA_GENERIC))
    bare = remove(remove(bare, r"\bverified\b"), V.INTERESTED_USERS)
    return f"trim({collapse(bare)}, {text(V.STRIP_CLEANED)})"


def clean_site(column: str) -> str:
    bare = remove(plain(column), phrases(V.CTA_SITE))
    bare = remove(remove(bare, V.INTERESTED_USERS), V.ADDED_BY)
    bare = remove(remove(bare, r"\bverified\b"), r"\bexclusive\b")
    return f"trim({collapse(bare)}, {text(V.STRIP_CLEANED)})"


def noise(column: str) -> str:
    low = f"lower({column})"
    return (
        f"(length({column}) < {V.MIN_LINE_CHARS} or {starts(low, V.QUESTION_PREFIXES)} "
        f"or (contains({column}, '@') and not {hit(column, V.EN_CODE)}) "
        f"or {low} in ({words(V.DEAL_HEADINGS + V.NAVIGATION_WORDS)}) "
        f"or {any_of(low, V.NOISE_PHRASES)})")


def site_noise(column: str) -> str:
    low = f"lower({column})"
    return (
        f"(length({column}) < {V.MIN_SITE_OFFER_CHARS} "
        f"or {starts(low, V.SITE_QUESTION_PREFIXES)} "
        f"or {any_of(low, V.SITE_NOISE_PHRASES)})")


def code_normal(column: str) -> str:
    return f"upper(trim({column}, {text(V.STRIP_CODE)}))"


def code_valid(column: str) -> str:
    return (
        f"(length({column}) between 3 and 20 "
        f"and regexp_full_match({column}, '[A-Z0-9-]+') "
        f"and not regexp_full_match({column}, '[0-9]+') "
        f"and {column} not in ({words(V.CODE_STOPWORDS)}) "
        f"and not regexp_full_match({column}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') "
        f"and not (regexp_full_match({column}, '[A-Z]+') and length({column}) < 5))")


LINES = f"lines as ({LINES_SQL})"
PIECES = r"list_filter(string_split_regex(c, '\s*(?:\||•|·)\s*'), lambda x: x <> '')"


def parts(source: str = "lines", keys: str = "line_id, page_id") -> str:
    """CTEs from (keys, line) to ``parts`` (keys, part_no, part) and gated ``offers``."""
    return f"""
cleaned as (select {keys}, {clean('line')} as c from {source}),
pieces as (select {keys}, c, {PIECES} as pieces from cleaned where c <> ''),
parts as (
  select {keys}, cast(i as integer) as part_no,
    case when len(pieces) > 1 then {clean('pieces[i + 1]')} else c end as part
  from (select *, unnest(range(greatest(len(pieces), 1))) as i from pieces)),
offers as (
  select * from (
    select {keys}, part_no, part, {clean('part')} as offer from parts
    where length(part) between {V.MIN_LINE_CHARS} and {V.MAX_LINE_CHARS})
  where offer <> '' and not {noise('offer')})"""


NUMBER_CAPTURES = {
    "percent": V.PERCENT_OFF, "upto_percent": V.EN_UP_TO_PERCENT, "extra": V.EN_EXTRA_OFF,
    "cashback": V.CASHBACK, "zh_extra": V.ZH_EXTRA_ZHE, "zh_low": V.ZH_LOW_ZHE,
    "zh_zhe": V.ZH_ZHE, "zh_cashback": V.ZH_CASHBACK, "ko_percent": V.KO_PERCENT,
    "ja_percent": V.JA_PERCENT, "es_percent": V.ES_PERCENT,
}
TEXT_CAPTURES = {
    "amount": V.AMOUNT_OFF, "upto_amount": V.UP_TO_AMOUNT_OFF, "save": V.EN_SAVE_AMOUNT,
    "code": V.EN_CODE, "zh_code": V.ZH_CODE, "zh_min": V.ZH_FULL_MINUS,
    "ko_code": V.KO_CODE, "ja_code": V.JA_CODE, "es_code": V.ES_CODE,
}
MARKS = {
    "shipping": V.EN_FREE_SHIPPING, "bogo": V.BOGO,
    "zh_shipping": "|".join(V.ZH_FREE_SHIPPING), "zh_bogo": V.ZH_BUY_GET,
    "ko_shipping": V.KO_FREE_SHIPPING, "ja_shipping": V.JA_FREE_SHIPPING,
    "es_shipping": V.ES_FREE_SHIPPING, "zh_word": "|".join(V.ZH_DEAL_WORDS),
    "word": V.EN_DEAL_WORD,
}


def _code(name: str, earlier: tuple[str, ...] = ()) -> str:
    code = code_normal(f"c_{name}")
    empty = f" and coalesce({', '.join(earlier)}) is null" if earlier else ""
    return f"case when {code_valid(code)}{empty} then {code} end as k_{name}"


def _zhe(column: str) -> str:
    return f"round((10 - {column}) * 10, 1)"


def _range(column: str, earlier: tuple[str, ...] = ()) -> str:
    empty = f" and coalesce({', '.join(earlier)}, null) is null" if earlier else ""
    return f"case when {column} > 0 and {column} <= 100{empty} then {column} end"


PERCENTS = (
    "p_zh_extra", "p_direct", "p_upto", "p_extra", "p_zh_low", "p_zhe", "p_korean",
    "p_japanese", "p_spanish",
)
CODES = ("k_zh_code", "k_code", "k_ko_code", "k_ja_code", "k_es_code")


def _count(events) -> str:
    return " + ".join(f"cast({event} as integer)" for event in events)


def _filled(columns) -> list[str]:
    return [f"({column} is not null)" for column in columns]


def signals(source: str) -> str:
    """CTEs ``captured`` and ``fields`` over ``source`` (…, offer)."""
    captured = [f"{number('offer', p)} as c_{n}" for n, p in NUMBER_CAPTURES.items()]
    captured += [f"{grab('offer', p)} as c_{n}" for n, p in TEXT_CAPTURES.items()]
    captured += [f"{grab('offer', V.ZH_FULL_MINUS, 2)} as c_zh_minus"]
    captured += [f"{hit('offer', p)} as m_{n}" for n, p in MARKS.items()]
    low = " and coalesce(p_zh_extra, p_direct, p_upto, p_extra) is null"
    steps = [
        f"{_range('c_percent')} as p_direct",
        f"{_zhe('c_zh_extra')} as p_zh_extra",
        f"{_range('c_upto_percent', ('p_direct',))} as p_upto",
        f"{_range('c_extra', ('p_direct', 'p_upto'))} as p_extra",
        f"case when true{low} then {_zhe('c_zh_low')} end as p_zh_low",
        f"case when c_zh_zhe > 0 and c_zh_zhe < 10 and c_zh_extra is null and c_zh_low is "
        f"null{low} then {_zhe('c_zh_zhe')} end as p_zhe",
        f"{_range('c_ko_percent', PERCENTS[:6])} as p_korean",
        f"{_range('c_ja_percent', PERCENTS[:7])} as p_japanese",
        f"{_range('c_es_percent', PERCENTS[:8])} as p_spanish",
        _code("code"), _code("zh_code"), _code("ko_code", CODES[:2]),
        _code("ja_code", CODES[:3]), _code("es_code", CODES[:4]),
        "case when c_upto_amount is null then c_amount end as a_off",
        "case when a_off is null then c_save end as a_save",
    ]
    sale = _count(_filled([*PERCENTS, "a_off", "c_upto_amount", "a_save", "c_zh_min"]))
    fields = [
        f"{sale} as n_sale",
        f"{_count(['m_shipping', 'm_zh_shipping', 'm_ko_shipping', 'm_ja_shipping', 'm_es_shipping'])}"
        " as n_shipping",
        f"{_count(_filled(['c_cashback', 'c_zh_cashback']))} as n_reward",
        f"{_count(['m_bogo', 'm_zh_bogo'])} as n_bogo",
        f"{_count(_filled(CODES))} as n_code",
        f"coalesce({', '.join(PERCENTS)}) as discount_percent",
        "coalesce(c_zh_minus, a_off, a_save) as discount_amount",
        "c_upto_amount as max_discount_amount",
        "coalesce(c_zh_cashback, c_cashback) as cashback_percent",
        f"coalesce({', '.join(CODES)}) as coupon_code",
        "case when c_upto_amount is not null or p_upto is not null then 'upto' end "
        "as discount_type",
        "n_sale + n_shipping + n_reward + n_bogo + n_code as strong_signals",
        f"{_count(['m_zh_word', 'm_word'])} as weak_signals",
        "case when n_code > 0 then 'COUPON' when n_bogo > 0 then 'BOGO' when n_reward > 0 "
        "then 'REWARD' when n_shipping > 0 then 'SHIPPING' when n_sale > 0 then 'SALE' end "
        "as offer_type",
    ]
    return f"""
captured as (select *, {', '.join(captured)} from {source}),
stepped as (select *, {', '.join(steps)} from captured),
fields as (select *, {', '.join(fields)} from stepped)"""


MIN_SPEND = (
    f"coalesce(c_zh_min, trim(coalesce({grab('offer', V.EN_AMOUNT_OFF_MIN_SPEND)}, "
    f"{grab('offer', V.EN_SHIPPING_MIN_SPEND)}, {grab('offer', V.EN_MIN_SPEND)})))")
EXPIRY = f"coalesce({grab('offer', V.EXPIRY_DATE)}, {grab('offer', V.EXPIRY_RELATIVE)})"
EXPIRY_TYPE = (
    f"case when {hit('offer', V.EXPIRY_DATE)} then 'date' "
    f"when {hit('offer', V.EXPIRY_RELATIVE)} then 'relative' end")

TERMS = (
    ("offer_type = 'COUPON'", 0.15, "coupon"),
    ("offer_type = 'REWARD'", 0.10, "reward"),
    ("offer_type = 'SALE'", 0.05, "sale"),
    ("offer_type = 'SHIPPING'", 0.12, "shipping"),
    ("offer_type = 'BOGO'", 0.18, "bogo_type"),
    ("discount_percent is not null or discount_amount is not null or "
     + hit("offer", V.AMOUNT_OFF), 0.22, "discount"),
    ("cashback_percent is not null", 0.18, "cashback"),
    ("max_discount_amount <> ''", 0.08, "max_discount"),
    ("min_spend <> ''", 0.10, "min_spend"),
    ("expiry_type = 'date'", 0.12, "expiry_date"),
    ("expiry_type = 'relative'", 0.04, "expiry_relative"),
    ("contains(lower(offer), 'free shipping')", 0.14, "free_shipping"),
    (hit("offer", V.BOGO), 0.14, "bogo"),
    ("contains(lower(offer), 'up to')", 0.06, "up_to"),
    ("store <> ''", 0.05, "store"),
    ("offer_type in ('COUPON', 'REWARD')", 0.05, "strong_dom_type"),
)


def score(base: str = "0.3") -> str:
    total = f"cast({base} as double)"
    for condition, points, _ in TERMS:
        total += f" + case when {condition} then cast({points} as double) else cast(0 as double) end"
    return f"greatest(cast(0 as double), least(cast(1 as double), {total}))"


def reasons(extra: str = "null") -> str:
    tags = [f"case when {condition} then '{tag}' end" for condition, _, tag in TERMS]
    return f"concat_ws(',', {', '.join(tags)}, {extra})"


MULTI = "(strong_signals >= 2 or (strong_signals >= 1 and weak_signals >= 1))"


def candidates(source: str) -> str:
    """CTEs to ``cand`` over ``source`` (page_id, ord_hi, ord_lo, store, offer)."""
    return f"""{signals(source)},
detailed as (
  select *, {MIN_SPEND} as min_spend, {EXPIRY} as expiry, {EXPIRY_TYPE} as expiry_type
  from fields where strong_signals > 0),
scored as (select *, {score()} as base_score from detailed),
cand as (
  select *, case when {MULTI} then least(cast(1 as double), base_score + cast(0.08 as double))
    else base_score end as confidence,
    {reasons(f"case when {MULTI} then 'multi_signal' end")} as reasons,
    '{V.GENERIC}' as source, offer as normalized_line
  from scored)"""


def short(column: str) -> str:
    return f"regexp_replace(cast({column} as varchar), '\\.0$', '')"


def text_key(column: str = "offer") -> str:
    return f"trim({collapse(f'lower({column})')})"


def offer_key() -> str:
    lead = f"trim({collapse('regexp_replace(lower(offer), ' + text(V.KEY_LEAD_INS) + ', ' + text('') + ')')})"
    percent = (
        f"case when discount_percent is not null then regexp_replace({lead}, "
        f"{text(V.KEY_PERCENT_OFF)}, {short('discount_percent')} || '% off', 'g') "
        f"else {lead} end")
    return (
        f"case when discount_amount <> '' then regexp_replace({percent}, "
        f"{text(V.KEY_AMOUNT_OFF)}, lower(discount_amount) || ' off', 'g') else {percent} end")


BEST = "confidence desc, ord_hi, ord_lo, offer"


def deduplicated(source: str = "cand") -> str:
    return f"""
keyed as (select *, {offer_key()} as offer_key from {source}),
deduped as (
  select * from keyed
  qualify row_number() over (partition by page_id, offer_key order by {BEST}) = 1),
kept as (select * from deduped where confidence >= cast({V.MIN_CONFIDENCE} as double)),
ranked as (
  select *, cast(row_number() over (partition by page_id order by {BEST}) as bigint) as rank
  from kept)"""


UNITS = 1 << 54


def mean_confidence(total: str, count: str) -> str:
    """Half-even mean of confidences to two digits; see scoring.mean_confidence."""
    a = f"(cast({total} / cast({UNITS} as double) / {count} * cast({UNITS} as double) as bigint) * 100)"
    q, r = f"({a} // {UNITS})", f"({a} % {UNITS})"
    return (
        f"({q} + case when {r} > {UNITS // 2} or ({r} = {UNITS // 2} and {q} % 2 = 1) "
        f"then 1 else 0 end) / cast(100 as double)")


UNIT_SUM = f"cast(sum(cast(confidence * cast({UNITS} as double) as bigint)) as double)"

FIRSTS = f"""
firsts as (
  select page_id, cast({1 << 40} as bigint) as ord_hi, min(line_id * 1024 + part_no) as ord_lo,
    'Shop ' || cast(page_id as varchar) as store, offer
  from offers group by page_id, offer)"""

GATED = f"with {LINES}, {parts()}"
CANDIDATES = f"{GATED}, {FIRSTS}, {candidates('firsts')}"
OFFERS = f"{CANDIDATES}, {deduplicated()}"

SUMMARIES = f"""
page_scores as (
  select page_id, count(*) as n, {mean_confidence(
      f"cast(sum(case when rank <= 5 then cast(confidence * cast({UNITS} as double) as bigint) end) as double)",
      "count(case when rank <= 5 then 1 end)")} as overall
  from ranked group by page_id),
summaries as (
  select s_suppkey as page_id, cast(coalesce(n, 0) as bigint) as candidate_count,
    coalesce(overall, cast(0 as double)) as overall_confidence
  from supplier left join page_scores on s_suppkey = page_id)"""
REPORTS = f"{OFFERS}, {SUMMARIES}"

OUTPUT_LINE = f"""concat_ws(' | ', coalesce(nullif(store, ''), '{V.UNKNOWN_STORE}'), offer,
  coalesce(coupon_code, offer_type, 'NO_CODE'),
  concat_ws(', ', 'type=' || lower(offer_type), 'cashback=' || {short('cashback_percent')} || '%',
    'max_discount=' || max_discount_amount, 'discount_amount=' || discount_amount,
    'discount=' || {short('discount_percent')} || '%', 'discount_type=' || discount_type,
    'expiry=' || expiry, 'expiry_type=' || expiry_type, 'min_spend=' || min_spend,
    'confidence=' || printf('%.2f', confidence)))"""
