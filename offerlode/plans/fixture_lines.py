"""Offer lines derived from ``lineitem`` and ``part``: one line per line item.

The driver's page and document tables hold no offers, so the line queries run over
these.  The text is plain SQL that Spark and DuckDB read alike.
"""

_CAST = "cast(cast({} as int) as varchar(9))"
_QTY = _CAST.format("l_quantity")
_SIZE = _CAST.format("p_size")
_DISC = _CAST.format("round(l_discount * 100)")
_TAX = _CAST.format("round(l_tax * 100)")
_NUM = _CAST.format("l_linenumber")


def _times(factor: int) -> str:
    return _CAST.format(f"p_size * {factor}")


def _plus(base: int) -> str:
    return _CAST.format(f"{base} + l_linenumber")


TEMPLATES = (
    f"concat('Save ', {_DISC}, '% off ', p_name, ' with code SAVE', {_QTY})",
    f"concat('Get $', {_QTY}, ' off orders over $', {_times(10)})",
    f"concat('Free shipping on orders $', {_times(5)}, '+')",
    f"concat('Members get ', {_TAX}, '% cash back on ', p_name)",
    f"concat('Buy ', {_NUM}, ', Get 1 free on ', p_name)",
    f"concat('Up to $', {_times(2)}, ' off ', p_brand, ' until May 10, 2026')",
    f"concat('额外', {_CAST.format('1 + mod(l_linenumber, 8)')}, '折 ', p_name)",
    f"concat('满', {_times(10)}, '减', {_SIZE}, '活动')",
    f"concat({_plus(5)}, '% 할인 세일 ', p_name)",
    f"concat('最大', {_plus(10)}, '%オフセール')",
    f"concat({_SIZE}, '% de descuento en ', p_name)",
    f"concat('Deal | ', p_name, ' ', {_SIZE}, '% off | limited time')",
    "concat('How can I return ', p_name, '?')",
    "'Contact support at help@store.com 20% off'",
    "concat(p_name, ' ', p_type)",
    f"concat('  Today only   ', {_SIZE}, '% off   sitewide  Show Code ')",
    "concat('Envío gratis en ', p_name)",
    f"concat('优惠码 EXTRA', {_QTY}, ' 有效至 2026-04-21')",
    f"concat('쿠폰 KOR', {_QTY}, ' 적용')",
    f"concat('クーポン：JPN', {_QTY}, ' 送料無料')",
    f"concat('código: AHORRO', {_QTY}, ' en ', p_name)",
    f"concat('무료 배송 ', {_SIZE}, '% off ', p_name)",
    f"concat({_QTY}, '%返利 包邮')",
    f"concat('清仓低至', {_CAST.format('1 + mod(l_linenumber, 9)')}, '折')",
    f"concat({_CAST.format('mod(p_size, 12)')}, '折 ', p_name)",
    f"concat('买', {_NUM}, '送1 限时')",
    f"concat('Save €', {_SIZE}, ' on ', p_name, ', ends today')",
    f"concat('Extra ', {_SIZE}, '%off, use code at checkout, code SAVE20')",
    f"concat('up to ', {_SIZE}, '%off ', p_brand, ' - additional $', {_QTY}, ' off')",
    f"concat('BOGO ', p_name, ' expiring soon; promo code ', {_QTY})",
    f"concat('flash sale! ', {_SIZE}, '% off or ', {_DISC}, '% off ', p_brand)",
    f"concat('SALE ', {_SIZE}, '% Off ', upper(p_brand), ' when you spend $', {_QTY})",
    "concat('Envio gratis en ', p_name)",
    f"concat('Codigo: PLAIN', {_QTY}, ' en ', p_name)",
    f"concat('cupom: DESC', {_QTY}, ' na loja')",
    f"concat('cupon AHORRO', {_QTY}, ' hoy')",
)

_CASES = "\n".join(
    f"    when {number} then {template}" for number, template in enumerate(TEMPLATES[:-1])
)

LINES_SQL = f"""
select l_orderkey * 10 + l_linenumber as line_id, l_suppkey as page_id,
  case mod(l_partkey + l_linenumber, {len(TEMPLATES)})
{_CASES}
    else {TEMPLATES[-1]}
  end as line
from lineitem join part on l_partkey = p_partkey
"""

PAGE_URL_SQL = (
    "concat('https://www.Deals', cast(page_id as varchar(19)), "
    "'.com/coupons/shop-', cast(page_id as varchar(19)), '_outlet.html')"
)
