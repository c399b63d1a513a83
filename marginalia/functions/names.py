"""Which strings may be names: Column predicates over fixed word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Common words that are no names, of counted candidates and of a model's names.
COMMON_WORDS = (
    "我们", "他们", "一个", "什么", "这个", "那样", "因为", "所以", "如果", "虽然",
    "然后", "只是", "这样", "不过", "可以", "已经", "自己", "现在", "之后",
    "的话", "时候", "如何", "为何", "从而", "因而", "为了", "这一", "那种",
    "那些", "这些", "这是", "那是", "那里", "这里", "于是", "可是", "而且", "或许",
    "一些", "所有", "不是", "不得", "但也", "不论", "以上", "以下", "以为",
    "一时", "一方", "大事", "之中", "之间", "之内", "之外", "以后", "以前",
    "就是", "没有", "他的", "她的", "它的", "时间", "一声", "还有", "中的", "心中",
    "之前", "手段", "有一", "还是", "都是", "正在", "突然", "不能", "不会",
    "然而", "显然", "似乎", "其中", "这种", "如此", "当中",
    "起来", "下去", "过来", "过去", "出来", "进去", "所有人", "其他人", "年轻人",
)
MODEL_WORDS = (
    "一个", "一些", "一下", "一声", "一切", "一定", "一直", "之前", "之后", "以后", "以前",
    "这里", "那里", "这个", "那个", "这些", "那些", "自己", "别人", "什么", "怎么", "为何",
    "因为", "所以", "但是", "不过", "只是", "如果", "虽然", "然后", "于是", "还是", "还有",
    "没有", "就是", "不是", "都是", "已经", "正在", "突然", "时间", "心中", "手段", "他的",
    "她的", "它的", "他们", "我们", "你们", "之中", "之间", "之内", "之外", "的时候",
)
THEME_WORDS = ("自由", "命运", "选择", "权力", "秩序", "混乱", "信仰", "人性", "神性", "文明", "记忆", "身份", "牺牲", "救赎", "复仇", "成长", "孤独", "真相", "谎言")
PUBLISHING_WORDS = ("作者", "小说", "网文", "版本", "校对", "全文", "书评", "读者", "写作", "创作", "起点")
GENERIC_ENDS = ("的人", "的时候", "的事情", "的东西", "的地方", "之中", "之间", "之后", "之前")
THEME_KINDS = ("功法", "物品", "种族", "组织", "地点")
NUMERALS, PARTICLES, MARKS = "零一二三四五六七八九十百千万两〇0123456789", "的是了在有也就都很还没不", r"[，。！？；：、“”‘’（）()《》【】\[\]{}<>]"
SHORT_BEGINS, SHORT_ENDS = "第这那有没不很还又再", "的了着过中里上下"


def _plain(name: Column) -> Column:
    """2 to 20 characters with a CJK one, no marks, and not a number."""
    short = (F.length(name) <= 3) & name.rlike(f"[{PARTICLES}]")
    return F.length(name).between(2, 20) & name.rlike(T.CJK) & ~name.rlike(MARKS) & ~name.rlike(f"^[{NUMERALS}]+$") & ~short


def is_candidate(token: Column) -> Column:
    """Whether a counted character run may be a name."""
    edge = (F.length(token) <= 3) & token.rlike(f"^[{SHORT_BEGINS}]|[{SHORT_ENDS}]$")
    return _plain(token) & ~token.rlike(r"(?U)\s") & ~token.isin(*COMMON_WORDS, *THEME_WORDS) & ~edge


def is_name(name: Column, evidence: Column | None = None, kind: Column | None = None) -> Column:
    """Whether a model's name may stand; one of four characters or fewer must be in its evidence, if there is any."""
    n = T.strip(name)
    theme = n.isin(*THEME_WORDS) if kind is None else n.isin(*THEME_WORDS) & ~F.coalesce(kind, F.lit("")).isin(*THEME_KINDS)
    ok = _plain(n) & ~n.isin(*MODEL_WORDS) & ~theme & ~n.rlike(f"({'|'.join(GENERIC_ENDS)})$")
    return ok if evidence is None else ok & ((F.coalesce(evidence, F.lit("")) == "") | F.contains(evidence, n) | (F.length(n) > 4))


def in_publishing_context(text: Column, start: Column, length: Column, reach: int = 48) -> Column:
    """Whether the text within ``reach`` characters of a place speaks of books rather than of the story."""
    begin = F.greatest(start - reach, F.lit(0))
    return T.has_any(F.substring(text, (begin + 1).cast("int"), (start + length + reach - begin).cast("int")), PUBLISHING_WORDS)
