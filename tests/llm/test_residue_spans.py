import random

from tagloom.llm import residue as M
from tests.llm.test_residue import WORDS, corpus

MESSAGES = ["页面不存在", "Please enable JavaScript to continue", "加载失败，点击重试", "系统繁忙，请稍后再试", "服务器内部错误", "This page requires cookies to be enabled"]


def test_messages_in_the_middle_of_a_content_line():
    rnd = random.Random(2)
    score = M.scorer(M.fit([p for _, t in corpus()[0] for p in M.passages(t)]))
    say = lambda: "".join(rnd.choice(WORDS) for _ in range(8)) + "。"
    for k, m in enumerate(MESSAGES * 5):
        t = say() + say() + say()
        at = rnd.randrange(10, len(t) - 10) if k % 2 else t.index("。") + 1
        assert score(t) < M.THRESHOLD <= score(t[:at] + m + t[at:]), (m, t)


def test_spans():
    cut = lambda p: [p[lo:hi].strip() for lo, hi in M.spans(p)]
    assert cut("甲升高。乙下降！404 Not Found丙不变") == ["甲升高。", "乙下降！", "404 Not Found丙不变", "404 Not Found"]
    assert cut("One. Two") == ["One.", "Two"] and cut("页面不存在") == []


def test_a_repeated_sentence_is_filler():
    assert M.periodic("本段略去，本段略去，本段略去，本段") and not M.periodic("细胞细胞") and not M.periodic("甲乙丙丁戊己庚辛壬癸子丑") and not M.periodic("")
