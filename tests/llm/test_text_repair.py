import pytest

from lectern.llm import confusables, mojibake

CLEAN = [
    "The naïve view of “help” doesn’t hold – see the résumé rules.", "Die Prüfungsakten für Übungszwecke gehören zur Größe der Fakultät.", "La evaluación según el módulo, aunque los exámenes sigan aparte.", "À propos des thèses : l’École doctorale précise les règles.",
    "评分标准与课程改革分开管理，截至目前由教务处答复。", "研究グループはデータの所在地とライセンス更新を比較する。", "강의 계획 시간으로 학생은 보고서를 확인한다.", "NÃO CONFUNDIR a avaliação com as instruções. DEFINIÇÕES E AVALIAÇÃO", "The word экзамен and the panel on λόγος, the scale value α.",
]


def documents(spark, garbled):
    rows = [(k, f"{CLEAN[k % len(CLEAN)]}\n{CLEAN[(k * 5 + 1) % len(CLEAN)]}", "t", f"https://h{k % 7}.example/x", None) for k in range(400)]
    rows += [(1000 + k, t, "t", "https://h1.example/y", None) for k, t in enumerate(garbled)] + [(2000, None, None, None, None), (2001, "", None, None, None)]
    return spark.createDataFrame(rows, "policy_doc_id long, text string, title string, url string, chain string")


CHAINS = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "latin-1")]


def test_finds_and_restores(spark):
    texts, true = [], []
    for written, read in CHAINS:
        for t in CLEAN[:4]:
            try:
                texts.append(t.encode(written).decode(read))
                true.append(t)
            except UnicodeDecodeError:
                pass
    texts += [CLEAN[6].encode("euc_kr").decode("latin-1"), CLEAN[4].encode("gbk").decode("latin-1"), "See the caf� rules"]
    true += [CLEAN[6], CLEAN[4], None]
    df = documents(spark, texts)
    found = mojibake.infer(df)
    ids = {r.policy_doc_id for r in found.collect()}
    assert ids == {1000 + k for k in range(len(texts))}
    restored = {r.policy_doc_id: (r.restored, r.complete) for r in mojibake.repair(df, found).collect()}
    good = [restored[1000 + k][0] == t for k, t in enumerate(true) if t]
    assert sum(good) >= 0.9 * len(good)
    assert not restored[1000 + len(texts) - 1][1]


def test_clean_and_empty(spark):
    assert mojibake.infer(documents(spark, [])).count() == 0
    assert mojibake.infer(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize(
    ("word", "plain"),
    [("ｔｈｅｓｉｓ", "thesis"), ("fea​tures", "features"), ("ﬁles", "files"), ("аѕѕist", "assist"), ("𝐬𝐚𝐧𝐜𝐭𝐢𝐨𝐧", "sanction"), ("é", "é"), ("ﾂｰﾙ", "ツール"), ("⽤于", "用于"), ("온하", "온하"), ("ex­am", "exam"), ("Под" + "p", "Подр"), ("５５", "55")],
)
def test_forms(word, plain):
    assert confusables.ordinary(word) == plain
    assert confusables.skeleton(word) == confusables.skeleton(plain)


@pytest.mark.parametrize("text", ["экзамен", "λόγος", "value α was", "“q” – it’s…", "。、「」：（）", "1.º 2ª x² ½ ™", "a\fb", "Ďatel Smørrebrød ß", "", " ", "生成AIツール", "naÃ¯ve Ã  la"])
def test_no_case(text):
    assert confusables.variants(text) == []


def test_frames(spark):
    rows = [(1, "a fea​ture ｔｈｅｓｉｓ"), (2, "plain"), (3, None), (4, ""), (5, "thesis un\xa0dos"), (1, "a fea​ture ｔｈｅｓｉｓ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "policy_doc_id long, text string, skeleton string")
    v = confusables.word_variants(df)
    assert {r.policy_doc_id for r in v.collect()} == {1, 5}
    groups = {r.skeleton: (r.ordinary, r.n_words) for r in confusables.skeleton_groups(v).collect()}
    assert groups["thesis"] == ("thesis", 2)
    out = {r.policy_doc_id: r.normalized for r in confusables.normalize(df).collect()}
    assert out[1] == "a feature thesis" and out[3] is None and out[4] == "" and out[5] == "thesis un dos"
    assert confusables.word_variants(df.limit(0)).count() == 0


def test_look_alikes_of_further_scripts_and_the_commonest_form(spark):
    for word, plain in (("\u13aaccess", "Access"), ("h\u0585me", "home"), ("\u1d18olicy", "policy"), ("\u2c9eK", "OK")):
        assert confusables.ordinary(word) == plain and confusables.skeleton(word) == confusables.skeleton(plain)
    for word in ("\u0562\u0561\u0580\u0565\u0582", "\u13e3\u13b3\u13a9", "\u0585"):
        assert confusables.ordinary(word) == word
    assert confusables.skeleton("co\u2010op") == confusables.skeleton("co-op") and confusables.ordinary("co\u2010op") == "co\u2010op"
    df = spark.createDataFrame([(1, "\u0420olicy of the desk", 0), (2, "Policy Policy", 0), (None, None, 0), (4, "", 0)], "policy_doc_id long, text string, form int")
    (row,) = confusables.word_variants(df).collect()
    assert (row.policy_doc_id, row.ordinary) == (1, "Policy")
    few, confusables.BROADCAST_WORDS = confusables.BROADCAST_WORDS, 0
    try:
        assert [r.ordinary for r in confusables.word_variants(df).collect()] == ["Policy"]
    finally:
        confusables.BROADCAST_WORDS = few
