"""The types of metrics and of expressions."""

from __future__ import annotations

from enum import StrEnum


class Kind(StrEnum):
    """What an operator takes and gives."""

    NUMERIC = "numeric"
    INT = "int"
    RATIO = "ratio"
    BOOL = "bool"
    EVENT = "event"
    CATEGORY = "category"
    DATE = "date"


# Fixed values of the inventory's format: business types (with their kind), time grains and the meanings of a missing value.
BUSINESS_KINDS = {"金额": Kind.NUMERIC, "计数": Kind.INT, "天数": Kind.NUMERIC, "比率": Kind.RATIO, "分类": Kind.CATEGORY, "布尔": Kind.BOOL, "文本": Kind.CATEGORY, "日期": Kind.DATE}
AMOUNT, COUNT = "金额", "计数"
NOT_NUMBERS = ("分类", "文本", "日期")
GRAINS = {"日": "day", "季": "quarter", "年": "year", "事件型": "event"}
MISSING = {"未维护、未授权查询和不适用需区分": "distinguish", "无记录、0值和缺失需区分": "distinguish_zero", "未维护或不适用": "unavailable_or_na", "主键缺失表示数据不可用": "primary_key"}

#: Kinds a column of doubles can hold.
SEARCHABLE = (Kind.NUMERIC, Kind.INT, Kind.RATIO, Kind.BOOL)


def fits(given: Kind, wanted: Kind) -> bool:
    """Whether a value of one kind may stand where another is wanted: whole numbers and ratios are numbers."""
    return given == wanted or (wanted == Kind.NUMERIC and given in (Kind.INT, Kind.RATIO))


def kind_of_literal(value) -> Kind:
    if isinstance(value, bool):
        return Kind.BOOL
    if isinstance(value, int):
        return Kind.INT
    return Kind.NUMERIC if isinstance(value, float) else Kind.CATEGORY
