"""Signal detectors: one cleaned line in, the fields of one candidate out."""

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlode.functions import scoring as S
from offerlode.functions import values as V
from offerlode.functions.regex import contains_any, grab, hit, some
from offerlode.functions.text import (
    fold, folds_plainly, is_ascii, is_coupon_code, keep_rows, normalize_code, to_number,
)

_CODE_WORDS = ("code", "coupon", "promo", "use", "apply")
_OTHER_CODE_WORDS = (
    "优惠码", "折扣码", "优惠券", "쿠폰", "할인코드", "프로모", "クーポン", "割引コード",
)
# Parts of Spanish and Portuguese words that are also written without accents.
_PLAIN_SIGNS = ("digo", "cup", "env")
_FOREIGN_SIGNS = (
    "折", "返利", "满", "买", "무료", "送料無料",
) + V.ZH_FREE_SHIPPING + _OTHER_CODE_WORDS


def with_folded(df: DataFrame, text: str = "offer",
                same: tuple[str, str] | None = None) -> DataFrame:
    """Add ``low`` and ``fold``.

    ``same`` names (changed, earlier): the fold of a row that did not change is the earlier one.
    """
    low, folded = F.lower(F.col(text)), fold(F.col(text))
    if same is not None:
        changed, earlier = map(F.col, same)
        low = F.when(changed | ~folds_plainly(F.col(text)), low).otherwise(earlier)
        folded = F.when(changed, folded).otherwise(earlier)
    return df.withColumns({"low": low, "fold": folded})


def may_have_signal(folded: Column) -> Column:
    """Superset of the lines with a strong signal, by substring tests only."""
    return (
        folded.contains("%") | folded.contains("$")
        | contains_any(folded, _CODE_WORDS + _PLAIN_SIGNS + ("free shipping", "bogo", "buy", "save"))
        | (~is_ascii(folded) & contains_any(folded, _FOREIGN_SIGNS))
    )


NUMBERS = (
    "percent", "upto_percent", "extra", "cashback", "zh_extra", "zh_low", "zh_zhe",
    "zh_cashback",
)


def captures(folded: Column, foreign: Column) -> dict[str, Column]:
    """``r_*``: first match of every detector that reads a value.

    Null where a cheap substring test rules the detector out, empty without a match.
    """
    percent = folded.contains("%")
    dollar = folded.contains("$")

    def among(words: tuple[str, ...]) -> Column:
        return foreign & contains_any(folded, words)

    detectors = {
        "percent": (percent, V.PERCENT_OFF),
        "amount": (dollar, V.AMOUNT_OFF),
        "upto_amount": (dollar & folded.contains("up to"), V.UP_TO_AMOUNT_OFF),
        "upto_percent": (percent & folded.contains("up"), V.EN_UP_TO_PERCENT),
        "extra": (percent & contains_any(folded, ("extra", "additional")), V.EN_EXTRA_OFF),
        "save": (folded.contains("save "), V.EN_SAVE_AMOUNT),
        "cashback": (percent & folded.contains("back"), V.CASHBACK),
        "code": (contains_any(folded, _CODE_WORDS), V.EN_CODE),
        "zh_extra": (among(("额外",)), V.ZH_EXTRA_ZHE),
        "zh_low": (among(("低至",)), V.ZH_LOW_ZHE),
        "zh_zhe": (among(("折",)), V.ZH_ZHE),
        "zh_cashback": (among(("返利",)), V.ZH_CASHBACK),
        "zh_code": (among(("优惠码", "折扣码", "优惠券")), V.ZH_CODE),
        "zh_min": (among(("满",)), V.ZH_FULL_MINUS),
        "ko_code": (among(("쿠폰", "할인코드", "프로모")), V.KO_CODE),
        "ja_code": (among(("クーポン", "割引コード")), V.JA_CODE),
        "es_code": (contains_any(folded, ("digo", "cup")), V.ES_CODE),
    }
    found = {
        f"r_{name}": F.when(gate, grab(folded, pattern))
        for name, (gate, pattern) in detectors.items()
    }
    found["r_zh_minus"] = F.when(among(("满",)), grab(folded, V.ZH_FULL_MINUS, 2))
    return found


def marks(folded: Column, foreign: Column) -> dict[str, Column]:
    """Detectors that only say yes or no."""
    return {
        "m_shipping": folded.contains("free shipping") & hit(folded, V.EN_FREE_SHIPPING),
        "m_bogo": S.offer_has_bogo(folded),
        "m_zh_shipping": foreign & contains_any(folded, V.ZH_FREE_SHIPPING),
        "m_zh_bogo": foreign & folded.contains("买") & hit(folded, V.ZH_BUY_GET),
        "m_ko_shipping": foreign & folded.contains("무료") & hit(folded, V.KO_FREE_SHIPPING),
        "m_ja_shipping": foreign & folded.contains(V.JA_FREE_SHIPPING),
        "m_es_shipping": folded.contains("env") & hit(folded, V.ES_FREE_SHIPPING),
        "m_zh_word": foreign & contains_any(folded, V.ZH_DEAL_WORDS),
        "m_word": contains_any(folded, ("coupon", "promo", "discount", "deal", "sale",
                                        "offer", "wide", "clearance"))
        & hit(folded, V.EN_DEAL_WORD),
    }


def capture_steps() -> dict[str, Column]:
    """``c_*``: captured texts and numbers, null without a match; ``m_*``: marks."""
    folded, foreign = F.col("fold"), F.col("_foreign")
    raw = captures(folded, foreign)
    values = {
        "c" + name[1:]: (to_number if name[2:] in NUMBERS else some)(F.col(name))
        for name in raw
    }
    return {"_foreign": ~is_ascii(folded), **raw, **marks(folded, foreign), **values}


def _in_range(value: Column) -> Column:
    return F.when((value > 0) & (value <= 100), value)


def _from_zhe(value: Column) -> Column:
    return S.round_tenth((F.lit(10.0) - value) * F.lit(10.0))


PERCENT_STEPS = (
    "p_direct", "p_upto", "p_extra", "p_zh_extra", "p_zh_low", "p_zhe", "p_korean",
    "p_japanese", "p_spanish",
)
# A Chinese "extra" discount overrides; the others only fill an empty percent.
PERCENT_WINNERS = (
    "p_zh_extra", "p_direct", "p_upto", "p_extra", "p_zh_low", "p_zhe", "p_korean",
    "p_japanese", "p_spanish",
)


#: What the events before the last resorts read, in the order of the winners.
_READ = ("p_zh_extra", "p_direct", "q_upto", "q_extra", "c_zh_low", "q_zhe")


def percent_steps() -> dict[str, Column]:
    """``p_*``: percent-setting events in evaluation order, null when not fired.

    An event fires if nothing before it was read, so each asks what was read (``q_*``) instead
    of the event before it; a chain would put a projection of all columns between any two.
    """
    c = F.col
    zhe = F.when((c("c_zh_zhe") > 0) & (c("c_zh_zhe") < 10) & c("c_zh_extra").isNull()
                 & c("c_zh_low").isNull(), _from_zhe(c("c_zh_zhe")))

    def empty(earlier: tuple[str, ...]) -> Column:
        return F.coalesce(*map(c, earlier)).isNull()

    def fill(earlier: tuple[str, ...], value: Column) -> Column:
        return F.when(empty(earlier), value)

    # Detectors that only fill an empty percent run only where it is empty.
    wanted = c("fold").contains("%") & empty(_READ)
    last = {"ko_percent": V.KO_PERCENT, "ja_percent": V.JA_PERCENT, "es_percent": V.ES_PERCENT}
    korean, japanese, spanish = [_in_range(c(f"c_{name}")) for name in last]
    return {
        "p_direct": _in_range(c("c_percent")),
        "p_zh_extra": _from_zhe(c("c_zh_extra")),
        "q_upto": _in_range(c("c_upto_percent")),
        "q_extra": _in_range(c("c_extra")),
        "q_zhe": zhe,
        "p_upto": fill(_READ[1:2], c("q_upto")),
        "p_extra": fill(_READ[1:3], c("q_extra")),
        "p_zh_low": fill(_READ[:4], _from_zhe(c("c_zh_low"))),
        "p_zhe": fill(_READ[:5], c("q_zhe")),
        **{f"r_{name}": F.when(wanted, grab(c("fold"), pattern)) for name, pattern in last.items()},
        **{f"c_{name}": to_number(c(f"r_{name}")) for name in last},
        "p_korean": korean,
        "p_japanese": F.when(korean.isNull(), japanese),
        "p_spanish": F.when(F.coalesce(korean, japanese).isNull(), spanish),
    }


CODE_CAPTURES = ("c_code", "c_zh_code", "c_ko_code", "c_ja_code", "c_es_code")


CODE_STEPS = ("k_code", "k_zh_code", "k_ko_code", "k_ja_code", "k_es_code")
# A Chinese code overrides the English one; the others only fill an empty code.
CODE_WINNERS = ("k_zh_code", "k_code", "k_ko_code", "k_ja_code", "k_es_code")


def code_steps() -> dict[str, Column]:
    """``k_*``: valid codes (``b_*``) in evaluation order, null when not taken."""
    steps = {}
    valid = ["b" + step[1:] for step in CODE_WINNERS]
    for step, capture in zip(CODE_STEPS, CODE_CAPTURES):
        code = F.col("v" + step[1:])
        steps["v" + step[1:]] = normalize_code(F.col(capture))
        steps["b" + step[1:]] = F.when(is_coupon_code(code), code)
        earlier = valid[:CODE_WINNERS.index(step)] if step in CODE_WINNERS[2:] else []
        own = F.col("b" + step[1:])
        steps[step] = F.when(
            F.coalesce(*map(F.col, earlier)).isNull(), own) if earlier else own
    return steps


def field_steps() -> dict[str, Column]:
    """Candidate fields, signal counts and the offer type from the captures."""
    c = F.col
    amount_off = F.when(c("c_upto_amount").isNull(), c("c_amount"))
    saved = F.when(amount_off.isNull(), c("c_save"))
    sale_events = [c(step).isNotNull() for step in PERCENT_STEPS] + [
        amount_off.isNotNull(), c("c_upto_amount").isNotNull(), saved.isNotNull(),
        c("c_zh_min").isNotNull(),
    ]
    reward_events = [c("c_cashback").isNotNull(), c("c_zh_cashback").isNotNull()]
    shipping_events = [
        c("m_shipping"), c("m_zh_shipping"), c("m_ko_shipping"), c("m_ja_shipping"),
        c("m_es_shipping"),
    ]
    bogo_events = [c("m_bogo"), c("m_zh_bogo")]
    code_events = [c(step).isNotNull() for step in CODE_STEPS]

    def count(events: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [event.cast("int") for event in events])

    return {
        "n_sale": count(sale_events),
        "n_shipping": count(shipping_events),
        "n_reward": count(reward_events),
        "n_bogo": count(bogo_events),
        "n_code": count(code_events),
        "discount_percent": F.coalesce(*map(c, PERCENT_WINNERS)),
        "discount_amount": F.coalesce(c("c_zh_minus"), amount_off, saved),
        "max_discount_amount": c("c_upto_amount"),
        "cashback_percent": F.coalesce(c("c_zh_cashback"), c("c_cashback")),
        "coupon_code": F.coalesce(*map(c, CODE_WINNERS)),
        "discount_type": F.when(
            c("c_upto_amount").isNotNull() | c("p_upto").isNotNull(), F.lit("upto")),
        "strong_signals": c("n_sale") + c("n_shipping") + c("n_reward") + c("n_bogo")
        + c("n_code"),
        "weak_signals": c("m_zh_word").cast("int") + c("m_word").cast("int"),
        "offer_type": offer_type(c("n_sale") > 0, c("n_shipping") > 0, c("n_reward") > 0,
                                 c("n_bogo") > 0, c("n_code") > 0),
    }


@lru_cache(maxsize=1)
def signal_columns() -> tuple[Column, ...]:
    """Built once per process; columns are not bound to a table."""
    steps = {**capture_steps(), **percent_steps(), **code_steps(), **field_steps()}
    return tuple(step.alias(name) for name, step in steps.items())


def with_signals(df: DataFrame) -> DataFrame:
    """All detector columns of lines that have ``fold``, in one select.

    Later steps refer to earlier ones as lateral aliases.
    """
    return df.select("*", *signal_columns())


def offer_type(sale: Column, shipping: Column, reward: Column, bogo: Column,
               code: Column) -> Column:
    """Highest-priority type among those seen; no order of arrival is needed."""
    return (
        F.when(code, "COUPON").when(bogo, "BOGO").when(reward, "REWARD")
        .when(shipping, "SHIPPING").when(sale, "SALE")
    )


# Every phrase of the general spend pattern ends in one of these.
_SPEND_WORDS = ("with ", "on ", "over ", "spend ", "purchase ", "of ")


def with_min_spend(df: DataFrame) -> DataFrame:
    """Spend threshold of a line; ``c_zh_min`` is the one read with its discount."""
    folded = F.col("fold")
    none = F.col("c_zh_min").isNull()
    df = df.withColumns({
        "_spend1": F.when(none & folded.contains("off "), grab(folded, V.EN_AMOUNT_OFF_MIN_SPEND)),
        "_spend2": F.when(
            none & folded.contains("free shipping"), grab(folded, V.EN_SHIPPING_MIN_SPEND)),
    })
    # The general pattern runs only where the special ones found nothing.
    open_spend = none & (F.coalesce(some(F.col("_spend1")), some(F.col("_spend2"))).isNull())
    df = df.withColumn("_spend3", F.when(
        open_spend & contains_any(folded, _SPEND_WORDS), grab(folded, V.EN_MIN_SPEND)))
    found = F.coalesce(*[some(F.col(name)) for name in ("_spend1", "_spend2", "_spend3")])
    return df.withColumn("min_spend", F.coalesce("c_zh_min", F.btrim(found))).drop(
        "_spend1", "_spend2", "_spend3")


def with_expiry(df: DataFrame, text: str = "offer") -> DataFrame:
    """Date or relative expiry; the captured text keeps its own case."""
    line, folded = F.col(text), F.col("fold")
    df = df.withColumns({
        "_date": F.when(folded.rlike(r"\p{Nd}{4}"), grab(line, V.EXPIRY_DATE, flags="(?iu)")),
        "_relative": F.when(
            contains_any(folded, ("limited time", "today", "soon")),
            grab(line, V.EXPIRY_RELATIVE, flags="(?iu)")),
    })
    return df.withColumns({
        "expiry": F.coalesce(some(F.col("_date")), some(F.col("_relative"))),
        "expiry_type": F.when(F.col("_date") != "", "date").when(
            F.col("_relative") != "", "relative"),
    }).drop("_date", "_relative")


PARSED_FIELDS = (
    "offer_type", "coupon_code", "discount_percent", "discount_amount",
    "max_discount_amount", "cashback_percent", "discount_type",
)
CANDIDATE_FIELDS = (
    "store", "offer", "source", "offer_type", "coupon_code", "discount_percent",
    "discount_amount", "max_discount_amount", "cashback_percent", "min_spend",
    "discount_type", "expiry", "expiry_type", "confidence", "reasons", "raw_html",
    "normalized_line",
)


@lru_cache(maxsize=None)
def _score_columns(folded: str | None) -> tuple[Column, Column]:
    terms = S.score_terms(S.folded_offer() if folded is None else F.col(folded))
    return S.confidence(terms).alias("_base"), S.reasons(terms).alias("_why")


def with_score(df: DataFrame, bonus: bool = True, folded: str | None = None) -> DataFrame:
    """Add ``confidence`` and ``reasons``; ``bonus`` needs the signal counts."""
    base, why = _score_columns(folded)
    if not bonus:
        return df.select("*", base.alias("confidence"), why.alias("reasons"))
    multi = (F.col("strong_signals") >= 2) | (
        (F.col("strong_signals") >= 1) & (F.col("weak_signals") >= 1))
    raised = F.least(F.lit(1.0), F.col("_base") + F.lit(V.MULTI_SIGNAL_BONUS))
    return df.select("*", base, why).select(
        *df.columns,
        F.when(multi, raised).otherwise(F.col("_base")).alias("confidence"),
        F.when(multi, F.array_append("_why", F.lit("multi_signal"))).otherwise(
            F.col("_why")).alias("reasons"))


def parse_offers(lines: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Candidates from cleaned, noise-free lines.

    ``lines`` has ``offer``, ``store``, ``fold`` and the columns named in ``keep``.
    """
    parsed = with_signals(lines)
    found = keep_rows(
        parsed, F.col("strong_signals") > 0, (*keep, "store"),
        ("offer", "fold", "c_zh_min", "strong_signals", "weak_signals", *PARSED_FIELDS))
    found = with_expiry(with_min_spend(found))
    # Every score is at least the base, so no row falls below KEEP_CONFIDENCE here.
    return with_score(found, folded="fold").select(
        *keep, "store", "offer", F.lit(V.GENERIC).alias("source"),
        *CANDIDATE_FIELDS[3:15], F.col("offer").alias("normalized_line"))
