from kgraph.llm.reference_list import Matcher

ENTRIES = {f"e{i}{j}": (h + t, []) for i, h in enumerate(["条形统计图", "分数", "小数乘法", "三角形"]) for j, t in enumerate(["的认识", "的应用", "的估测", "的比较"])}


def test_whole_mention_beside_another_content():
    m = Matcher(ENTRIES)
    assert m.match("条形统计图的认识")[:2] == ("e00", "mention")
    for k in ("条形统计图的认识和分数", "分数与条形统计图的应用"):
        entry, how, _ = m.match(k)
        assert how != "mention" and (entry is None or entry in ENTRIES)


def test_no_candidate_is_cut_off_before_the_filters():
    # four short contents are nearer to 甲乙丙丁戊己 than the long one, but leave too many of its characters out
    long = "己戊丁丙乙甲庚辛"
    contents = ["丁丙甲乙", "戊乙丁丙", "己丁丙戊", "甲己丙戊", long]
    entries = {f"e{i}{j}": (h + t, []) for i, h in enumerate(contents) for j, t in enumerate(["的认识", "的应用", "的估测", "的比较"])}
    assert Matcher(entries).match("甲乙丙丁戊己的认识")[:2] == ("e40", "similar")
