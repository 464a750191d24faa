"""Numbers, counts, durations and cue words in requests."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.functions import text as tx

# Numerals and cue words.
NUMERALS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10,
            "十一": 11, "十二": 12, "十三": 13, "十四": 14, "十五": 15}
DIGITS = "[一二两三四五六七八九十]+"
S = f"[{tx.SPACE}]*"
UNIT_WORDS = {"页": "(?:page|slide)", "条": "(?:bullet|point|item)"}
TOO_FULL = ("太满", "太多", "太挤", "挤", "太密", "字太多", "内容太多", "放不下", "too full", "too much", "crowded", "too dense")
TO_SCRIPT = ("讲稿", "口述", "说就行", "只说", "口头", "script", "just say", "say it")
SHORTEN = ("短", "精简", "简短", "压缩", "缩短", "简化", "shorten", "shorter", "trim", "condense")
THIS_PAGE = ("这页", "该页", "本页", "这一页", "this slide", "this page")
WHOLE_TALK = ("整体", "全部", "总共", "总时长", "整个", "报告", "whole", "total", "talk")
WHOLE_TALK_SHORT = ("整体", "全部", "总共", "whole", "talk")
MORE_TIME = ("多给", "延长", "增加", "加", "more", "longer")
LESS_TIME = ("少", "减", "缩", "快", "less", "shorter", "faster")
SPARSER = ("稀疏", "少一点", "留白", "清爽", "干净", "简洁", "空一些", "sparse", "airy", "cleaner")
DENSER = ("紧凑", "密", "多放", "塞满", "紧密", "compact", "denser", "tighter")
SPLIT = ("拆", "分成", "分两页", "split", "break into")
SPLIT_POINTS = ("拆点", "拆分要点")
DELETE = ("删", "去掉", "不要", "移除", "remove", "delete", "drop")
KEEP = ("一定要", "必须留", "固定", "保留在页面", "别动", "keep", "pin", "must stay")
RESERVE = ("备用", "备份页", "附录", "backup", "appendix", "reserve")
OUT_OF_RESERVE = ("拿出来", "放回", "不要备用", "out of")
WITH_FIGURE = ("配图", "加张图", "放张图", "图文", "配张图", "picture", "with figure")
IMPORTANT = ("最重要", "重点", "强调", "突出", "key point", "most important", "emphasi")
MERGE = ("合并", "合起来", "并成一条", "merge", "combine")
OPEN_QUOTE, CLOSE_QUOTE = "[「『\"'“]", "[」』\"'”]"
QUOTED = f"{OPEN_QUOTE}([^」』\"'”]{{1,40}}){CLOSE_QUOTE}"
REPLACE = (rf"把?{S}{OPEN_QUOTE}([^」』\"'”]{{1,60}}){CLOSE_QUOTE}{S}(?:改|换|替换|改成|换成){S}"
           rf"{OPEN_QUOTE}([^」』\"'”]{{1,80}}){CLOSE_QUOTE}")


def has(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def numeral(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])[c]


def _either(found: Column, value: Column, rest: Column) -> Column:
    """``value`` where the cue stands, even when it cannot be read; the next cue otherwise."""
    return F.when(found.isNotNull(), value).otherwise(rest)


def ordinal(c: Column | str, unit: str) -> Column:
    """The n of a page or item named by number."""
    c = tx.col(c)
    digits = _first(c, rf"第{S}(\p{{Nd}}+){S}{unit}")
    signs = _first(c, rf"第{S}({DIGITS}){S}{unit}")
    english = _first(c, rf"(?i){UNIT_WORDS[unit]}{S}(\p{{Nd}}+)")
    return _either(digits, digits.cast("int"), _either(signs, numeral(signs), english.cast("int")))


def count_phrase(c: Column | str) -> Column:
    """How many trailing items are meant."""
    c = tx.col(c)
    digits = _first(c, rf"(?:后|最后){S}(\p{{Nd}}+){S}(?:条|个|点|句)")
    signs = _first(c, rf"(?:后|最后){S}({DIGITS}){S}(?:条|个|点|句)")
    last = _first(c, rf"(?i)last[{tx.SPACE}]+(\p{{Nd}}+)")
    words = (F.when(c.rlike(rf"(?i)last[{tx.SPACE}]+two"), 2).when(c.rlike(rf"(?i)last[{tx.SPACE}]+three"), 3)
             .when(c.rlike(rf"(?i)last[{tx.SPACE}]+last one"), 1))
    return _either(digits, digits.cast("int"), _either(signs, numeral(signs), _either(last, last.cast("int"), words)))


def duration_seconds(c: Column | str) -> Column:
    """Minutes or seconds named in a request, as seconds."""
    c = tx.col(c)
    minutes = _first(c, rf"(?iU)(\d+(?:\.\d+)?){S}(?:分钟|分|minutes?|mins?|min)\b")
    signs = _first(c, rf"({DIGITS}){S}分钟")
    seconds = _first(c, rf"(?iU)(\d+){S}(?:秒|seconds?|secs?)\b")
    by_sign = numeral(signs) * 60
    return F.coalesce((minutes.cast("double") * 60).cast("int"), by_sign, seconds.cast("int"))
