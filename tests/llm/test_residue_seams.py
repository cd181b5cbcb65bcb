import pytest

from tagloom.llm import residue as M
from tests.llm.test_residue import WORDS, corpus


@pytest.mark.parametrize("message", ["{{ 标题 }}", "<%= analysis %>", "页面不存在"])
def test_a_message_across_a_cut(message):
    score = M.scorer(M.fit([p for _, t in corpus()[0] for p in M.passages(t)]))
    one = "".join(WORDS) + "。"
    sound = one * (M.PASSAGE // len(one) + 1)
    for at in (M.PASSAGE - 3, 2 * M.PASSAGE - 2):
        t = (sound * 2)[:at] + message + sound
        best = max(score(p) for p in [*M.passages(t), *M.seams(t)])
        assert best >= M.THRESHOLD > max(score(p) for p in [*M.passages(sound * 3), *M.seams(sound * 3)])
        assert any(message in p for p in M.seams(t)) and not any(message in p for p in M.passages(t))


def test_the_query_scores_seams():
    import pyarrow as pa

    t = "龘" * (M.PASSAGE - 2) + "页面不存在" + "龘" * 50
    odds = {f"{a}\x00{b}": 9.0 for a, b in zip("页面不存", "面不存在")}
    own = lambda c: next(iter(M._scored(odds)(iter([pa.RecordBatch.from_pydict({"id": [1], "text": [c]})])))).to_pydict()
    assert "页面不存在" in own(t)["passage"][0]


def test_a_seam_halves_no_formula():
    t = "龘" * (M.PASSAGE - M.SEAM - 2) + "F_{2}" + "龘" * 300
    assert [p[:6] for p in M.seams(t)][0] == "F_{2}龘"
