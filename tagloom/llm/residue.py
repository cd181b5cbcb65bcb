"""Template residue and error-page text.

Passages (lines, long ones in pieces) are bags of features: tokens, pairs of neighbouring tokens, the shape around each symbol, and signs of
filler (repetition, no function words). A naive
Bayes model is learnt from positive and unlabelled passages by expectation-maximization: the positives are the trusted records below
(messages, filler and slots, written down as fixed values by family), the unlabelled ones a bounded sample of the corpus' own passages (SAMPLE distinct
passages at most, chosen by hash). Each round gives every unlabelled passage its probability of being residue and
re-estimates both classes; a few trusted sentences of content that only speaks of errors, scripts or templates are held on the content side. Then
every passage of every document is scored by its sum of log-odds, by its best stretch of neighbouring tokens, from which FREE is taken off unless it
holds the sign of a slot, and by the sums of its sentences and of its runs of Latin text, each as if it stood alone (so that a slot or a message in
the middle of real content counts as itself). A document's score is its best passage's.

Defined cases: null and empty texts score 0 and are no cases; texts are scored whole, in pieces of at most PASSAGE characters a passage and
once more around each cut;
repeated rows of one id give one row; an empty table gives no row and needs no model."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.runtime import spread, table

SAMPLE = 20_000  # unlabelled passages that the model is fitted on, at most
PASSAGE = 400
SEAM = 200  # characters to either side of a cut; the longest trusted record has 160
ROUNDS, PRIOR, SMOOTH, MASS, TRUST, SLOT, COUNTER, TEMPER = 3, 0.01, 1.5e-7, 1_000.0, 4.0, 1.0, 10.0, 0.1
THRESHOLD = 5.0
FREE = 2.5  # what a stretch without a slot's sign must have above the threshold: content reaches 5.3 on sf0.1
MEMO = 2_000_000  # tokens in context whose value a task remembers, at most
NEW = -1.0  # log-odds of a feature that the model hasn't seen

# Trusted records by family. Messages of error, missing, blocked and loading pages and of failed programs, notices, filler and test
# text. They are common wordings of such pages, not taken from a corpus that is to be scored.
RECORDS = """\
## status
404 Not Found
Error 404: the requested page could not be found
HTTP Error 403
HTTP Error 500
Error 500: the requested item could not be loaded
400 Bad Request
401 Unauthorized
403 Forbidden
408 Request Timeout
429 Too Many Requests
500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
Internal Server Error
Bad Gateway
Service Unavailable
Gateway Timeout
错误码：404
错误码：500
错误代码 502
## permission
Access denied
Permission denied
You do not have permission to view this page.
You may not have permission to access this item.
没有权限查看此内容
没有权限访问该页面
## missing
This page isn't available right now
This page could not be displayed
Sorry, the page you are looking for does not exist
页面不存在
页面不存在（404）
您访问的页面不存在
您访问的内容已下架或被移除
您访问的题目已被删除
可能的原因：链接失效、内容审核中。
## trouble
Oops! Something went wrong
Something went wrong. Please try again later.
Please try again later or go back to the home page.
抱歉，出错了
抱歉，您访问的页面出错了
服务器内部错误
服务暂时不可用
系统繁忙，请稍后再试
系统维护中，请稍后访问
网络异常，请检查网络设置
网络开小差了
## slow
The server took too long to respond.
The connection has timed out
Too many requests, please slow down
请求超时，请刷新重试
请求过于频繁，请稍后再来
请求过于频繁，请 5 分钟后再来
## reference
Request ID 8f3a21bc90de
Reference 402917736650
status=404 trace=7b1c90aa4f3e
status=500 trace=d02e6617c5b8
(0be19c7d52fa)
请求编号 3f60a1d4e98b
## session
Your session has expired, please log in again
登录已过期，请重新登录
登录已过期，请重新登录后查看
请先登录后查看
## loading
Loading...
loading...
Loading, please wait
Please wait while the page is loading
加载失败，点击重试
正在加载，请稍候
正在加载，请稍候……若长时间无响应，请检查网络
## robot
Checking your browser before accessing the site
Please verify you are human
请输入验证码后继续访问
## navigation
刷新页面
返回首页
返回首页 | 联系客服
5 秒后自动跳转到首页
## scripts
Please enable JavaScript to continue
Please enable cookies and JavaScript to continue
JavaScript is disabled in your browser
You need to enable JavaScript to run this app.
This site requires cookies; turn them on and reload.
This viewer requires scripts; turn them on and reload.
本页面需要启用 JavaScript 才能显示，请在浏览器设置中打开后刷新。
请启用 Cookie 后继续
请允许脚本运行以查看内容
您的浏览器未启用脚本，部分内容无法显示。
您的浏览器未开启脚本功能，页面无法正常显示。
脚本被拦截，加载中止
请检查是否禁用了脚本
## browser
Your browser is not supported, please upgrade your browser
Please turn off your ad blocker
浏览器版本过低，请升级后重试。
浏览器版本过低，无法显示，请升级后重试。
## program
Traceback (most recent call last):
File "main.py", line 12, in run
KeyError: 'name'
ValueError: invalid literal
TypeError: 'NoneType' object is not subscriptable
Uncaught TypeError: cannot read properties of undefined (reading 'title')
ReferenceError: item is not defined
java.lang.NullPointerException
at app.View.render(View.java:88)
Exception in thread "main"
Segmentation fault (core dumped)
SQLSTATE[42S02]: table users doesn't exist
Fatal error: Uncaught exception
Warning: undefined variable
## service
{"code":500,"msg":"service timeout","data":null}
{"error":"not found","status":404}
## nothing
[object Object]
undefined
null
NaN
None
## latin
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam eaque ipsa quae ab illo inventore veritatis.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit.
lorem ipsum lorem ipsum lorem ipsum
## keys
xxx xxx xxx xxx xxx xxx
xxxx xxxx xxxx
XXXXXXXXXXXX
asdfasdfasdf
asdf asdf qwer qwer
asdf
qwer qwer qwer
## test
test test test test
this is a test
测试测试测试测试
测试数据，仅供测试，请忽略
测试文本测试文本测试文本
测试题目，请勿作答
## placeholder
sample text sample text
placeholder text
placeholder text, replace before release
Sample question text
insert text here
your text here
to be filled in
TBD
N/A
样例文字样例文字样例文字
样例题干样例题干
示例文字示例文字
示例文本，请替换
占位内容，占位内容，占位内容，
这是占位文字，这是占位文字，这是占位文字，
占位文字占位文字
本段文字只用于排版，本段文字只用于排版，本段文字只用于排版，
本段为示意文本，正式内容稍后更新
请替换为正式内容后再发布
请替换为正式题目后再发布 1
内容内容内容内容
选项 A：选项内容
答案为答案内容
标题：标题内容
啊啊啊啊啊啊啊啊啊啊啊啊
待填写
内容待补充
## untitled
未命名文档
未命名文档 1
新建题目
新建文档
共 0 题
（共 0 条）
共 0 条
"""


def families() -> dict[str, list[str]]:
    """The trusted records by family."""
    out: dict[str, list[str]] = {}
    for line in RECORDS.splitlines():
        if line.startswith("## "):
            own = out.setdefault(line[3:], [])
        else:
            own.append(line)
    return out


# The forms of an unfilled slot, and names that stand in one.
SLOTS = """\
{{N}}
{{ N }}
{{{N}}}
${N}
$!N.text
$N.text
#{N}
<%= N %>
<% N %>
{% include 'N' %}
{% N %}
{N|default}
%(N)s
%N%
@@N@@
[[N]]
[[INSERT U HERE]]
[INSERT U HERE]
[插入C]
[此处填写C]
#U#
__U__
XXXXCXXXX
TODO: C
TODO: N
TBD: C
FIXME: N
<C待补>
【请在此处填写C】
【待填写C】
（此处为C内容）
（此处填写C）
[[C]]
{{C}}
{{ C }}
：{0}
：{1}
：{2}
：{3}
。{0}
。{1}
。{2}
""".splitlines()
#: What a slot stands in; the words are of no meaning, so that only their kind is learnt.
AROUND = ["@", "：@", "龘。@龘龘", "龘龘@龘龘。", "龘龘@", "qzx @Qzx", "9@龘"]
NAMES = "title stem analysis answer_text options label_name question_id parent_stem teacher difficulty name item_title".split()
CJK_NAMES = "标题 题干 解析 答案 选项 知识点 题号 来源 难度 教师 名称 内容".split()

# Words that running English text has every few words.
FUNCTION_WORDS = set("a after also an and are as at be because but by could during each for from had has have in into is it its may means no not of on only or so than that the their then these this to under was were twice under when which while will with within without".split())

# Trusted content that only speaks of such things.
CONTENT = """\
编号404的样方未找到目标植物，记为缺失。
第500号样本的读数出现错误，已重新测量。
该错误源于把底物浓度算错，改正后误差为5%。
用脚本控制光照，每12小时切换一次。
动物需要适应后才会正常活动。
数据采集服务器每10分钟记录一次，断电期间的数值缺失。
肿瘤的占位效应会压迫周围组织。
以模板链为准，转录出的mRNA长300个碱基。
该未命名的物种只见于高山。
样品不足，待补充后再测。
营养液待补充之后，实验继续进行。
示例：若亲本为杂合子，则填写表中第2行。
取样过于频繁时，稍后再取。
鸟类访问花朵过于频繁时，会稍后再来。
集合{甲, 乙}表示两种配子，[2]为图号。
样本标签写作 #7-C#，百分号%表示相对湿度。
请写出该过程的名称______。
(1)______，(2)______。
The 404 seeds that could not be found were counted as lost.
Access to food was denied for two days and the animals slept more.
The error bars show one standard deviation.
The server of the weather station recorded the temperature every hour.
The page of the notebook was missing, so the values were measured again.
The template strand is read from one end to the other.
The script of the experiment was followed by all groups.
An exception to this rule was found in two plants.
Samples were tested twice in each group.
【题干】下列叙述正确的是（   ）
题目：下列分析错误的是（   ）
【选项】A. 第一项
A. 第一项
【答案】A
【答案】AC
【答案】A；C
【答案】(1)：空1：甲；空2：乙 / 丙；(2)：空1：丁
【答案】12/5
答案：A
答案：AD
答案：B；C
答案：H_{2}O
答案：parts：blanks：空1：甲；空2：3.5；note：通常
参考答案 AB
参考答案 空1：甲；空2：乙
【解析】略
解析：略
详解 略
【解析】【分析】甲与乙的比例为3:1。
计算式为\\frac{2}{x_{1}+1}，其中x_{1}取3.5。
F_{2}中性状的分离比为3:1，NO_{3}^{-}的含量升高。
""".splitlines()

TOKEN = re.compile(r"[0-9a-f]{10,}|[A-Za-z]+(?:_[A-Za-z]+)*|\d+|[一-鿿㐀-䶿]|[!-/:-@\[-^`{-~_]{1,3}|[^\s]")
HEX = re.compile(r"(?=.*\d)[0-9a-f]{10,}")
SYMBOL = re.compile(r"[!-/:-@\[-^`{-~_【】（）〔〕《》「」…]")
SIGN = re.compile(r"[{}<>$%@#\[\]【】（]|__|^todo$|^tbd$|^fixme$|^xxxx$|^w_w$|^<unit>$")
UNIT = re.compile(r"(.{1,6}?)\1{2,}")


def passages(text: str):
    """The lines of a text, long ones in pieces."""
    for line in text.splitlines():
        s = line.strip()
        for lo in range(0, len(s), PASSAGE):
            yield s[lo : lo + PASSAGE]


INK, INK_BEFORE = re.compile(r"[!-~]*"), re.compile(r"[!-~]*\Z")


def seams(text: str):
    """What stands around each cut that passages() makes: SEAM characters to either side, and up to 40 more so that no formula or word is halved."""
    for line in text.splitlines():
        s = line.strip()
        for at in range(PASSAGE, len(s), PASSAGE):
            head, tail = INK_BEFORE.search(s, at - SEAM - 40, at - SEAM), INK.match(s, at + SEAM, at + SEAM + 40)
            yield s[head.start() : tail.end()]


SENTENCE = re.compile(r"[。！？；!?;]|\.(?=\s)")
LATIN = re.compile(r"[ -~]{6,}")


def spans(passage: str) -> list[tuple[int, int]]:
    """Where the sentences of a passage and its runs of Latin text are, without those that are all of it."""
    cuts = [0, *(m.end() for m in SENTENCE.finditer(passage)), len(passage)]
    parts = list(zip(cuts, cuts[1:])) + ([] if passage.isascii() else [m.span() for m in LATIN.finditer(passage)])
    return [(lo, hi) for lo, hi in dict.fromkeys(parts) if hi - lo < len(passage) and not passage[lo:hi].isspace() and lo < hi]


def _word(token: str) -> str:
    """A token's own feature: numbers, hexadecimal ids, names with underscores and words of one repeated unit are each one word."""
    c = token[0]
    if c.isdigit():
        return "<hex>" if len(token) >= 10 and HEX.fullmatch(token) else "9"
    if c.isalpha() and c.isascii():
        if len(token) >= 4 and UNIT.fullmatch(token):
            return "<unit>"
        return "<hex>" if len(token) >= 10 and HEX.fullmatch(token) else "w_w" if "_" in token else token.lower()
    return token


def _shape(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return "9"
    if "一" <= c <= "鿿" or "㐀" <= c <= "䶿":
        return "C"
    if c.isalpha() and c.isascii():
        return "U" if token.isupper() and len(token) > 2 else "w"
    return token


def periodic(passage: str) -> bool:
    """Whether a passage is one stretch of four characters or more, three times or more, and perhaps a part of it."""
    d = passage.find(passage[:4], 4) if len(passage) >= 12 else -1
    return 0 < d <= len(passage) // 3 and passage[d:] == passage[:-d]


LETTERS, NUMBER, CJK, MARK, END = range(5)
KNOWN: dict[str, tuple[str, str, int]] = {}


def _known(token: str) -> tuple[str, str, int]:
    """(word, shape, kind) of a token, remembered."""
    w, shape = _word(token), _shape(token)
    if shape in ("w", "U"):
        kind = LETTERS
    elif shape == "C":
        kind = CJK
    else:
        kind = NUMBER if shape == "9" else END if w[0] in ".;!?" or not w.isascii() else MARK
    if len(KNOWN) > MEMO:
        KNOWN.clear()
    KNOWN[token] = out = (w, shape, kind)
    return out


def tokens(passage: str) -> tuple[list[tuple[str, str, int]], list[int]]:
    """The (word, shape, kind) of each token, and where it begins."""
    out, at, get = [], [], KNOWN.get
    for m in TOKEN.finditer(passage):
        t = m.group()
        out.append(get(t) or _known(t))
        at.append(m.start())
    return out, at


def contexts(toks: list[tuple[str, str, int]], repeated: bool = False) -> list[tuple]:
    """What each token's features depend on: (word before, word, shape before, shape, shape behind, last, filler, again)."""
    out, before, left, plain, last = [], "^", "^", 0, len(toks) - 1
    words = [t[0] for t in toks]
    for k, (w, own, kind) in enumerate(toks):
        again = repeated
        if kind == LETTERS:
            plain = 0 if w in FUNCTION_WORDS else plain + 1
        elif kind == NUMBER or kind == END or kind == CJK:
            plain = 0
        if k > 3 and (kind == LETTERS or kind == CJK) and w in words[k - 4 : k]:
            again = again or k < 8 or words[k - 8 : k].count(w) > 1
        out.append((before, w, left, own, toks[k + 1][1] if k < last else "$", k == last, plain >= 7 and kind == LETTERS, again))
        before, left = w, own
    return out


def expand(context: tuple) -> list[str]:
    """A token's features: itself, with its neighbour, its shape among its neighbours', and signs of filler."""
    before, w, left, own, right, last, filler, again = context
    if filler:  # nothing else is asked of such a word but itself
        f = [w, "<no function words>", "<no function words>"]
    else:
        f = [f"{before}\x00{w}"]
        if own != "C":
            f.append(w)
        if last:
            f.append(f"{w}\x00$")
        if SYMBOL.match(w):
            f.append(f"{left}\x01{w}\x01{right}")
        elif own != "C" or SYMBOL.match(left) or SYMBOL.match(right):
            f.append(f"{left}\x02{own}\x02{right}")
    if again:
        f.append("<again>")
    return f


def features(passage: str) -> list[list[str]]:
    return [expand(c) for c in contexts(tokens(passage)[0], periodic(passage))]


def trusted(records: dict[str, list[str]] | None = None) -> list[tuple[str, float]]:
    """The positive passages with their weights: records (all families, if none are given), and each form of a slot with several names and surroundings."""
    plain = list(chain.from_iterable((families() if records is None else records).values()))
    slots = []
    for form in SLOTS:
        for name, cjk in zip(NAMES, CJK_NAMES):
            slot = form.replace("N", name).replace("U", name.upper()).replace("C", cjk) if re.search("[NUC]", form) else form
            slots += [c.replace("@", slot, 1) for c in AROUND]
    return [(p, TRUST) for p in dict.fromkeys(plain)] + [(p, SLOT) for p in dict.fromkeys(slots)]


def fit(unlabelled: list[str], records: dict[str, list[str]] | None = None) -> dict[str, float]:
    """feature -> log-odds of residue against content, by expectation-maximization over positive and unlabelled passages."""
    number: dict[str, int] = {}
    seen: dict[tuple, tuple[int, ...]] = {}

    def bags(passages_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct features of each passage, one after the other, and the passage that each belongs to."""
        ids: list[int] = []
        ends = []
        for p in passages_:
            own: set[int] = set()
            for c in contexts(tokens(p)[0], periodic(p)):
                if (f := seen.get(c)) is None:
                    f = seen[c] = tuple(number.setdefault(x, len(number)) for x in expand(c))
                own.update(f)
            ids += own
            ends.append(len(ids))
        return np.array(ids, np.int64), np.repeat(np.arange(len(passages_)), np.diff([0, *ends]))

    known = trusted(records)
    sure, of_sure = bags([p for p, _ in known])
    sound, _ = bags(CONTENT)
    open_, of_open = bags(unlabelled)
    n = len(number)
    weight = np.array([w for _, w in known])
    total = lambda ids, w: np.bincount(ids, w, n)
    trusted_pos, trusted_neg = total(sure, weight[of_sure]), total(sound, np.full(len(sound), TRUST * COUNTER))
    chance = np.full(len(unlabelled), PRIOR)
    base, odds = math.log(PRIOR / (1 - PRIOR)), np.zeros(n)
    for _ in range(ROUNDS):
        pos, neg = trusted_pos + total(open_, chance[of_open]), trusted_neg + total(open_, 1 - chance[of_open])
        np_, nn = pos.sum(), neg.sum()
        # Both classes are smoothed towards the feature's overall share, so a feature that is rare everywhere says little.
        share = MASS * (pos + neg) / (np_ + nn)
        odds = np.log((pos + share) / (np_ + MASS)) - np.log((neg + share + SMOOTH * nn) / (nn + MASS))
        # Features overlap, so the evidence of a passage is tempered.
        evidence = base + TEMPER * np.bincount(of_open, odds[open_], len(unlabelled))
        chance = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
    return {x: v for x, v in zip(number, odds.tolist()) if abs(v) > 0.05}


def scorer(odds: dict[str, float]):
    """passage -> the largest of its sum of log-odds (a token counts with the mean of its features), its best stretch that holds a slot's sign,
    its best stretch of any kind less FREE, and the sums of its spans."""
    known: dict[tuple, tuple[float, bool]] = {}

    def value(c: tuple) -> tuple[float, bool]:
        f = expand(c)
        if len(known) > MEMO:
            known.clear()
        known[c] = v = (sum(odds.get(x, NEW) for x in f) / len(f), SIGN.search(c[1]) is not None)
        return v

    def odds_of(c: tuple) -> float:
        return (known.get(c) or value(c))[0]

    def alone(toks: list, cs: list, upto: list, i: int, j: int) -> float:
        """What tokens i to j would sum up to as a passage of their own: the passage's sum, with the contexts that end at the span's edges put right."""
        if i and toks[i - 1][2] in (LETTERS, MARK):
            return sum(map(odds_of, contexts(toks[i:j])))
        own: dict[int, tuple] = {}
        if i:
            c = cs[i]
            own[i] = ("^", c[1], "^", *c[3:7], False)
            for g in range(i + 1, min(i + 8, j)):  # a word counts as used again within its own span only
                w, _, kind = toks[g]
                again = g - i > 3 and (kind == LETTERS or kind == CJK) and any(w == t[0] for t in toks[g - 4 : g])
                if again != cs[g][7]:
                    own[g] = (*cs[g][:7], again)
        if j < len(toks):
            c = own.get(j - 1, cs[j - 1])
            own[j - 1] = (*c[:4], "$", True, *c[6:])
        return upto[j] - upto[i] + sum(odds_of(c) - odds_of(cs[g]) for g, c in own.items())

    def score(passage: str) -> float:
        best = free = run = 0.0
        signs = 0
        toks, at = tokens(passage)
        repeated = periodic(passage)
        cs = contexts(toks, repeated)
        upto = [0.0]
        for c in cs:
            v, sign = known.get(c) or value(c)
            upto.append(upto[-1] + v)
            run += v
            if run <= 0:  # a stretch may begin right after its opening sign
                run, signs = 0.0, int(sign)
                continue
            signs += sign
            if run > free:
                free = run
            if signs and run > best:
                best = run
        parts = 0.0
        for lo, hi in spans(passage):
            i, j = bisect_left(at, lo), bisect_left(at, hi)
            if i < j and (s := sum(map(odds_of, contexts(toks[i:j]))) if repeated else alone(toks, cs, upto, i, j)) > parts:
                parts = s
        return max(best, upto[-1], free - FREE, parts)

    score.alone, score.odds_of = alone, odds_of  # for tests
    return score


EVERY = re.compile(TOKEN.pattern + r"|\s+")
#: Bits of a context's number: a token's class, the shape behind it, and three flags.
CLASS, SHAPE = 21, 15
#: Passages that are scored at once.
PACK = 2_000


class BatchScorer:
    """scorer() for many passages at once: tokens become numbers, contexts are built, looked up and summed as arrays. The same scores, up to rounding."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.single = odds, scorer(odds)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of a token, -1 for white space
        self.classes: dict[tuple, int] = {}
        self.shapes: dict[str, int] = {"$": 0}
        self.words: dict[str, int] = {}
        self.values: dict[int, float] = {}
        self.shape_names = ["$"]
        self.rows: list[tuple] = []  # (word, shape, kind, word's number, shape's number, is a function word, has a slot's sign)
        self.table = np.zeros((0, 5), np.int64)
        self._class(("^", "^", MARK))

    def _class(self, t: tuple[str, str, int]) -> int:
        if (c := self.classes.get(t)) is None:
            c = self.classes[t] = len(self.rows)
            w, shape, kind = t
            if shape not in self.shapes:
                self.shapes[shape] = len(self.shapes)
                self.shape_names.append(shape)
            self.rows.append((w, shape, kind, self.words.setdefault(w, len(self.words)), self.shapes[shape], w in FUNCTION_WORDS, SIGN.search(w) is not None))
        return c

    def _numbers(self, tokens_: list[str]) -> list[int]:
        known = self.number
        try:
            return [known[t] for t in tokens_]
        except KeyError:
            for t in tokens_:
                if t not in known:
                    known[t] = -1 if t.isspace() else self._class(KNOWN.get(t) or _known(t))
            return [known[t] for t in tokens_]

    def _value(self, key: int) -> float:
        again, filler, last = key & 1, key >> 1 & 1, key >> 2 & 1
        right = key >> 3 & (1 << SHAPE) - 1
        own, before = key >> 3 + SHAPE & (1 << CLASS) - 1, key >> 3 + SHAPE + CLASS
        w, shape, *_ = self.rows[own]
        f = expand((self.rows[before][0], w, self.rows[before][1], shape, self.shape_names[right], bool(last), bool(filler), bool(again)))
        v = self.values[key] = sum(self.odds.get(x, NEW) for x in f) / len(f)
        return v

    def _looked_up(self, keys: np.ndarray) -> np.ndarray:
        one, back = np.unique(keys, return_inverse=True)
        get = self.values.get
        return np.array([v if (v := get(k)) is not None else self._value(k) for k in one.tolist()], np.float64)[back]

    def scores(self, passages_: list[str]) -> np.ndarray:
        out = np.zeros(len(passages_))
        for lo in range(0, len(passages_), PACK):
            out[lo : lo + PACK] = self._pack(passages_[lo : lo + PACK])
        return out

    def _pack(self, texts: list[str]) -> np.ndarray:
        if len(self.rows) > (1 << CLASS) * 3 // 4 or len(self.shapes) > (1 << SHAPE) * 3 // 4 or len(self.values) > MEMO:
            self.clear()
        ids: list[int] = []
        sizes: list[int] = []
        counts = []
        for t in texts:
            toks = EVERY.findall(t)
            ids += self._numbers(toks)
            sizes += map(len, toks)
            counts.append(len(toks))
        if len(self.table) < len(self.rows):
            more = np.array([r[2:] for r in self.rows[len(self.table) :]], np.int64)
            self.table = np.concatenate([self.table, more]) if len(self.table) else more
        cid, size, passage = np.array(ids, np.int64), np.array(sizes, np.int64), np.repeat(np.arange(len(texts)), counts)
        begin = np.cumsum(size) - size
        seen = cid >= 0
        cid, begin, passage = cid[seen], begin[seen], passage[seen]
        if not len(cid):
            return np.zeros(len(texts))
        n = np.bincount(passage, minlength=len(texts))
        end = np.cumsum(n)
        first = end - n
        kind, word, shape, function, sign = self.table[cid].T
        i = np.arange(len(cid))
        k = i - first[passage]
        last = i == end[passage] - 1
        before = np.where(k == 0, 0, np.r_[0, cid[:-1]])
        right = np.where(last, 0, np.r_[shape[1:], 0])
        letters = kind == LETTERS
        wordy = letters | (kind == CJK)
        near, far = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64)
        for s in range(1, 9):
            same = np.zeros(len(cid), np.int64)
            same[s:] = (word[s:] == word[:-s]) & (k[s:] >= s)
            far += same
            if s <= 4:
                near += same
        again = wordy & (k > 3) & (near > 0) & ((k < 8) | (far > 1))
        whole_periods = np.array([periodic(t) for t in texts])
        counted = np.cumsum(letters & (function == 0))
        cut = np.maximum.accumulate(np.where((letters & (function == 1)) | (kind == NUMBER) | (kind == END) | (kind == CJK), i, -1))
        start = first[passage]
        base = np.where(cut >= start, counted[np.maximum(cut, 0)], np.where(start > 0, counted[np.maximum(start - 1, 0)], 0))
        filler = letters & (counted - base >= 7)
        key = lambda b, c, r, z, f, g: (((b << CLASS | c) << SHAPE | r) << 3) | z.astype(np.int64) << 2 | f.astype(np.int64) << 1 | g.astype(np.int64)
        own = key(before, cid, right, last, filler, again)
        v = self._looked_up(own)
        total = np.r_[0.0, np.cumsum(v)]
        some = np.flatnonzero(n)
        # Best stretches: the sum up to a token less the least sum before it, passage by passage (each is shifted below all sums of the one before).
        t = total[1:] - total[start]
        shift = (t.max() - min(t.min(), 0.0) + 1.0) * passage
        least = np.minimum(np.minimum.accumulate(t - shift) + shift, 0.0)
        run = np.maximum(t - least, 0.0)
        reset = run <= 1e-7
        since = np.maximum(np.maximum.accumulate(np.where(reset, i, -1)), start)
        signs = np.cumsum(sign)
        signed = signs - np.where(since > 0, signs[np.maximum(since - 1, 0)], 0) > 0
        score = np.zeros(len(texts))
        top = lambda x: np.maximum.reduceat(x, first[some])
        score[some] = np.maximum.reduce([np.zeros(len(some)), total[end[some]] - total[first[some]], top(run) - FREE, top(np.where(signed & ~reset, run, 0.0))])
        self._add_spans(score, texts, whole_periods, key, own, v, total, cid, begin, before, right, last, filler, again, kind, wordy, near, first, end, np.cumsum([0, *map(len, texts)]))
        for p in np.flatnonzero(whole_periods):
            score[p] = self.single(texts[p])
        return score

    def _add_spans(self, score, texts, skip, key, own, v, total, cid, begin, before, right, last, filler, again, kind, wordy, near, first, end, base) -> None:
        """Raise each passage's score to that of its best span, as if it stood alone."""
        parts = [(p, lo + base[p], hi + base[p]) for p, t in enumerate(texts) if not skip[p] for lo, hi in spans(t)]
        if not parts:
            return
        p, lo, hi = np.array(parts, np.int64).T
        i, j = np.searchsorted(begin, lo), np.searchsorted(begin, hi)
        keep = i < j
        p, i, j, lo, hi = p[keep], i[keep], j[keep], lo[keep], hi[keep]
        inner, cut = i > first[p], j < end[p]
        odd = inner & np.isin(kind[np.maximum(i - 1, 0)], (LETTERS, MARK))
        s = total[j] - total[i]
        which, places, keys = [], [], []
        for o in range(8):  # the tokens at a span's beginning
            m = np.flatnonzero(inner & (i + o < j))
            g = i[m] + o
            ends = (g == j[m] - 1) & cut[m]
            new = key(before[g] if o else np.zeros(len(g), np.int64), cid[g], np.where(ends, 0, right[g]), ends | last[g], filler[g], wordy[g] & (near[g] > 0) if o > 3 else np.zeros(len(g), bool))
            differs = new != own[g]
            which.append(m[differs])
            places.append(g[differs])
            keys.append(new[differs])
        m = np.flatnonzero(cut & ~(inner & (j - 1 - i < 8)))  # and at its end
        g = j[m] - 1
        which.append(m)
        places.append(g)
        keys.append(key(before[g], cid[g], np.zeros(len(g), np.int64), np.ones(len(g), bool), filler[g], again[g]))
        which, places, keys = map(np.concatenate, (which, places, keys))
        if len(keys):
            s = s + np.bincount(which, self._looked_up(keys) - v[places], len(s))
        for x in np.flatnonzero(odd):  # a run of words goes on across the span's beginning
            toks, at = tokens(texts[p[x]])
            inside = toks[bisect_left(at, lo[x] - base[p[x]]) : bisect_left(at, hi[x] - base[p[x]])]
            s[x] = sum(map(self.single.odds_of, contexts(inside)))
        np.maximum.at(score, p, s)


def _sampled(share: float):
    """Mapper (text) -> (h, passage): the partition's distinct passages whose hash lies in the first `share` of its range."""
    edge = int(share * 2**63)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            kept: dict[int, str] = {}
            for t in b.column(0).to_pylist():
                for p in passages(t or ""):
                    if p and (h := xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) >> 1) < edge and h not in seen:
                        seen.add(h)
                        kept[h] = p
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.string())], ["h", "passage"])

    return run


#: Where a text's lines end, as splitlines() has it.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def sample(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> list[str]:
    """The `size` distinct passages of the corpus with the smallest hashes (all of them, if there are fewer).

    What is looked at is a share of the range of hashes, from a count of all passages; where copies and blank lines leave too few in it, the share is
    widened. A partition sends `size` passages at most."""
    n = docs.agg(F.sum(F.size(F.split(text, LINE_ENDS)) + F.floor(F.length(text) / PASSAGE)).alias("n")).first().n or 0
    share = min(1.0, 1.5 * size / max(1, n))
    while True:
        rows = spread(docs.select(text)).mapInArrow(_sampled(share), "h long, passage string").distinct().orderBy("h", "passage").limit(size).collect()
        if len(rows) == size or share == 1.0:
            return [r.passage for r in rows]
        share = min(1.0, 4 * share)


def model(docs: DataFrame, text: str = "text", size: int = SAMPLE) -> dict[str, float]:
    return fit(sample(docs, text, size))


def _scored(odds: dict[str, float]):
    """Mapper (id, text) -> (id, score, passage)."""

    def run(batches):
        scorer_ = BatchScorer(odds)
        for b in batches:
            texts = [list(chain(passages(t or ""), seams(t or ""))) for t in b.column(1).to_pylist()]
            every = list(chain.from_iterable(texts))
            s = scorer_.scores(every)
            best, at = [], 0
            for own in texts:
                part = s[at : at + len(own)]
                k = int(part.argmax()) if len(own) else 0
                best.append((float(part[k]), every[at + k]) if len(own) and part[k] > 0 else (0.0, None))
                at += len(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in best], pa.float64()), pa.array([x for _, x in best], pa.string())], ["id", "score", "passage"])

    return run


def residue_scores(docs: DataFrame, row_id: str, text: str = "text", size: int = SAMPLE) -> DataFrame:
    """(id, score, passage): each document's score and the passage that gave it."""
    kind = docs.schema[row_id].dataType.simpleString()
    return spread(docs.select(F.col(row_id).alias("id"), text)).mapInArrow(_scored(model(docs, text, size)), f"id {kind}, score double, passage string")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return residue_scores(table(spark, d, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores}
ORACLES: dict[str, str] = {}
