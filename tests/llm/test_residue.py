import random

from tagloom.llm import residue as M

WORDS = "细胞 叶绿体 酵母 番茄 果蝇 根尖 培养液 蔗糖 光照 样方 密度 实验 处理 升高 下降 含量 速率 杂交 基因 蛋白".split()
REAL = ["编号500的样方未找到目标，记为缺失。", "待补充完毕后继续观察。", "集合{A, B}表示两种配子，[2]为图号。", "填写表格：______和______。", "CO_{2}与O_{2}的比例为3:1。"]
CASES = ["{{ 标题 }}", "404 Not Found", "页面不存在", "Please enable JavaScript to continue", "Traceback (most recent call last):", "系统繁忙，请稍后再试", "Lorem ipsum dolor sit amet consectetur adipiscing elit", "[object Object]", "@@analysis@@", "测试测试测试测试测试测试", "加载失败，点击重试"]
# Wordings that stand in no trusted record.
UNSEEN = [
    "{{ chapter_no }}", "HTTP 404 - page not found", "您要访问的网页不存在", "JavaScript must be enabled to continue", "TypeError: 'int' object is not callable", "服务器繁忙，请您稍后重试", "Dolor lorem amet consectetur ipsum adipiscing sed elit sit",
    "@@remark@@", "资源加载失败，请点击重试", "您的会话已过期，请重新登录", "Sorry, we can't find that page", "网站正在维护，请稍后再来", "此内容暂时无法显示", "Cookies are required to use this site", "当前浏览器不支持该功能，请更换浏览器",
    "NullReferenceException: Object reference not set", "数据库连接失败", "页面加载超时，请重试", "You are not authorized to view this resource", "对不起，您没有访问权限", "Network error, please check your connection", "内容正在加载中，请耐心等待", "Dummy text goes here",
    "这里填写题干", "占位符文本", "该链接已失效", "文章已被作者删除", "ERR_CONNECTION_REFUSED", "Fatal: out of memory", "请在此输入内容", "请开启 JavaScript 后重新加载本页", "账号在其他设备登录，请重新登录",
]


def corpus():
    rnd = random.Random(1)
    say = lambda: "".join(rnd.choice(WORDS) for _ in range(rnd.randrange(6, 14))) + "。"
    docs, cases = [], set()
    for k in range(600):
        t = "".join(say() for _ in range(rnd.randrange(2, 6)))
        if k % 20 == 0:
            x = CASES[k // 20 % len(CASES)]
            t = [x, t + "\n" + x, t + x + say() if x[0] in "{@" else x + "\n" + t][k // 20 % 3]
            cases.add(k)
        elif k % 7 == 0:
            t += rnd.choice(REAL) + say()
        docs.append((k, t))
    return docs, cases


def run(spark, docs):
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    return {r.id: r.score for r in M.residue_scores(df, "doc_id").collect()}


def sf_passages(sf="sf0.01"):
    import pyarrow.parquet as pq

    return sorted({p for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet").column("text").to_pylist() for p in M.passages(t or "") if p})


def test_unseen_wordings():
    """Messages in other words than the trusted records', by a model fitted on the small table."""
    own = [r for f in M.families().values() for r in f]
    assert not any(c in r or r in c for c in UNSEEN for r in own if len(r) > 5)
    score = M.scorer(M.fit(sf_passages()))
    missed = [c for c in UNSEEN if score(c) < M.THRESHOLD]
    assert len(missed) <= 0.2 * len(UNSEEN), missed


def test_planted_records(spark):
    docs, cases = corpus()
    scores = run(spark, docs)
    got = {k for k, s in scores.items() if s >= M.THRESHOLD}
    assert len(got & cases) >= 0.95 * len(cases), cases - got
    assert len(got - cases) <= 0.02 * len(docs), [docs[k] for k in got - cases]


def test_dirt(spark):
    scores = run(spark, [(1, None), (2, ""), (3, "  \n"), (4, "{{ name }}"), (4, "{{ name }}"), (5, "细胞" * 100_000), (None, "404 Not Found")])
    assert scores[1] == scores[2] == scores[3] == 0 and scores[4] >= M.THRESHOLD and scores[5] < M.THRESHOLD
    assert run(spark, []) == {}


def test_sample_is_bounded_and_does_not_depend_on_layout(spark, monkeypatch):
    docs, _ = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(M, "fit", lambda passages: seen.append(passages) or {})
    for n in (1, 5):
        M.model(df.repartition(n), size=50)
    assert seen[0] == seen[1] and len(seen[0]) == 50


def test_sample_holds_its_bound_on_any_line_ends(spark):
    """Copies and blank lines leave the sample whole, and it never exceeds its bound, whatever ends a line."""
    docs, _ = corpus()
    for end in ("\r", "\u2028", "\x85", "\n"):
        rows = [(k, (end * 5).join([docs[0][1]] * 30 + [t])) for k, (_, t) in enumerate(docs[:120])]
        got = M.sample(spark.createDataFrame(rows, "doc_id long, text string"), size=40)
        assert len(got) == len(set(got)) == 40


def test_each_family_left_out():
    """How much of a family of records is found by what the others taught; README has the figures of each."""
    plain = sf_passages()
    every, hit, whole = M.families(), {}, 0
    for name, own in every.items():
        score = M.scorer(M.fit(plain, {k: v for k, v in every.items() if k != name}))
        hit[name] = sum(score(r) >= M.THRESHOLD for r in own) / len(own)
        whole += sum(score(r) >= M.THRESHOLD for r in own)
    share = whole / sum(map(len, every.values()))
    print({k: round(v, 2) for k, v in hit.items()}, share)
    assert 0.25 <= share


def test_spans_score_as_passages_of_their_own():
    docs, _ = corpus()
    plain = [p for _, t in docs for p in M.passages(t)]
    score = M.scorer(M.fit(plain))
    texts = plain[:200] + ["See Fig. 2. The the the server took too long. Lorem ipsum (a.) dolor dolor. X", "细胞404 Not Found细胞。细胞细胞 细胞！A; B; C", "测试测试测试测试测试", "。", "a. b"]
    for t in texts:
        toks, at = M.tokens(t)
        cs = M.contexts(toks, False)
        upto = [0.0]
        for c in cs:
            upto.append(upto[-1] + score.odds_of(c))
        for i in range(len(toks)):
            for j in (i + 1, i + 2, i + 6, i + 11, len(toks)):
                if j <= len(toks) and (i == 0 or toks[i - 1][2] not in (M.LETTERS, M.MARK)):
                    want = sum(score.odds_of(c) for c in M.contexts(toks[i:j]))
                    assert abs(score.alone(toks, cs, upto, i, j) - want) < 1e-6, (t, i, j)


def test_batches_score_as_single_passages():
    plain = sf_passages("sf0.001")
    odds = M.fit(plain)
    texts = plain + UNSEEN + ["", "   ", "See Fig. 2. The the the server took too long. Lorem ipsum (a.) dolor dolor. X", "细胞404 Not Found细胞。细胞细胞 细胞！A; B; C", "测试测试测试测试测试", "。", "a. b", "a b c d e f g h i j. k l m n o p"]
    one, many = M.scorer(odds), M.BatchScorer(odds)
    assert max(abs(a - one(t)) for a, t in zip(many.scores(texts), texts)) < 1e-6
    many.clear()
    assert abs(many.scores(["{{ name }}", ""]) - [one("{{ name }}"), 0.0]).max() < 1e-9 and len(many.scores([])) == 0
