import numpy as np
import pytest

from lectern.llm import boilerplate, consensus, langid, residue

SENTENCES = {
    "en": ["Students must document the portfolio tasks before each deadline in shared repositories.", "The graduate school treats the survey responses like personal data of the students."],
    "de": ["Die Studierenden dokumentieren die Portfolioaufgaben vor jeder Abgabe auf verwalteten Geräten.", "Der Prüfungsausschuss behandelt die Umfragedaten wie die Personendaten der Lehrenden."],
    "fr": ["Les étudiants documentent les dossiers de travaux avant chaque remise sur tous les sites.", "La commission pédagogique assimile les réponses aux données personnelles des vacataires."],
    "es": ["Los estudiantes documentan los portafolios antes de cada entrega en todas las sedes.", "La comisión de calidad equipara las encuestas con los datos personales de los tutores."],
    "pt": ["Os estudantes documentam os portefólios antes de cada entrega em todos os polos.", "A comissão pedagógica equipara os inquéritos aos dados pessoais das docentes."],
    "zh": ["学生在共享平台上应当记录项目展示和课程改革。", "学术委员会把个人信息与访问日志分别处理。"],
    "ja": ["学生は提出の前に学習日誌とポートフォリオを保管する。", "教務課は個人情報とアクセスログを区別する。"],
    "ko": ["학생은 제출 전에 학습 일지와 과제 발표 자료를 보관한다.", "교무처 담당자가 개인정보와 접속 기록 문제를 나누어 다룬다."],
}


LANGS = tuple(SENTENCES)


def labels(spark):
    return spark.createDataFrame([(x, x) for x in LANGS] + [("English", "en")], "spelling string, lang string")


def documents(spark):
    rows = []
    for k in range(160):
        lang = LANGS[k % 8]
        a, b = SENTENCES[lang]
        rows.append((k, f"w{k} {a} w{k} {b} w{k} {a}\n\nw{k} {b} w{k} {a} w{k} {b}", lang, "html", 1))
    en, de = SENTENCES["en"], SENTENCES["de"]
    rows += [
        (1000, f"{en[0]} {en[1]} {en[0]}\n\n{en[1]} {en[0]}", "de", "html", 1), (1001, f"{en[0]} {en[1]} {en[0]}\n\n{de[0]} {de[1]} {de[0]}", "en", "html", 1), (1002, f"{de[0]} {de[1]}", None, "pdf", 1), (1003, f"{en[0]} She said “{de[0]}” and {en[1]}", "English", "html", 1),
        (1004, None, "en", "html", 1), (1005, " \n", "en", None, 1), (1006, f"{en[0]} {en[1]}", "klingon", None, 1),
    ]
    return spark.createDataFrame(rows, "policy_doc_id long, text string, language_declared string, extension string, lang int")


def test_languages(spark):
    detected = langid.detect(documents(spark), labels(spark)).cache()
    main = {r.policy_doc_id: r.lang for r in detected.where("main").collect()}
    assert all(main[k] == LANGS[k % 8] for k in range(160)) and 1004 not in main and 1005 not in main
    found = {(r.policy_doc_id, r.lang) for r in langid.mislabelled(detected).collect()}
    assert found == {(1000, "en"), (1001, "en"), (1001, "de"), (1002, "de"), (1006, "en")}
    parts = langid.detect(documents(spark), labels(spark), by_segment=True).where("policy_doc_id = 1001").collect()
    assert {(r.para_no, r.lang) for r in parts} == {(0, "en"), (1, "de")} and all(0 <= r.confidence <= 1 for r in parts)
    assert langid.detect(documents(spark).limit(0), labels(spark)).count() == 0


def test_other_languages_and_every_segment(spark):
    known = documents(spark)
    ninth = "Studenter skal dokumentere oppgavene sine før hver innlevering på delte områder."
    rows = [(2000 + k, f"w{k} {ninth} w{k} {ninth}\n\n{ninth} w{k}", "no", "html", 1) for k in range(20)]
    rows += [(3000, "Студенты документируют задания перед каждой сдачей в общих хранилищах факультета.\n\n" * 2, None, "html", 1)]
    rows += [(3001, f"# Überschrift der Seite\n\n- {SENTENCES['de'][0]}\n- {SENTENCES['de'][1]}\n- {SENTENCES['ko'][0]}\n\nScope\n\n{SENTENCES['de'][0]} {SENTENCES['de'][1]}", "de", "html", 1)]
    df = known.union(spark.createDataFrame(rows, known.schema))
    table = labels(spark).union(spark.createDataFrame([("no", "no"), ("norsk", None), (None, "xx")], "spelling string, lang string"))
    main = {r.policy_doc_id: r.lang for r in langid.detect(df, table).where("main").collect()}
    assert all(main[2000 + k] == "no" for k in range(20)) and main[3000] == langid.OTHER and main[3001] == "de" and all(main[k] == LANGS[k % 8] for k in range(160))
    found = {r.policy_doc_id for r in langid.mislabelled(langid.detect(df, table)).collect()}
    assert 3000 not in found and not any(2000 + k in found for k in range(20))
    parts = [(r.para_no, r.segment_no, r.lang) for r in langid.detect(df, table, by_segment=True).where("policy_doc_id = 3001").orderBy("para_no", "segment_no").collect()]
    assert {p for p, *_ in parts} == {0, 1, 2, 3} and (1, 0, "de") in parts and (1, 1, "ko") in parts
    none = langid.detect(df, table.limit(0)).collect()
    assert none and {r.lang for r in none} == {langid.OTHER}


def test_notices_in_long_lines_and_of_one_host(spark):
    word = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    notice = "The office answers all questions of this kind."
    rows = [(k, f"The {word(k)} text has a line of its own that is longer than all its other lines together, {word(k)} or not.", f"https://h{k % 89}.example/") for k in range(8000)]
    rows += [(9000 + k, f"{word(9000 + k)} begins a text of its own {'and goes on ' * 20} here. {notice}", "https://one.example/") for k in range(4)]
    everywhere, own = langid.notices(spark.createDataFrame(rows, "id long, text string, url string"), "text", id_col="id", url_col="url")
    assert everywhere == set()
    found = {r.id_: langid.Sentences(set(r.own_)) for r in own.collect()}
    assert found.keys() == {9000 + k for k in range(4)} and all(notice in x and len(x.hashes) == 1 for x in found.values())
    small = spark.createDataFrame(rows[-10:], "id long, text string, url string")
    everywhere, own = langid.notices(small, "text", id_col="id", url_col="url")
    assert notice in langid.Sentences(everywhere) and len(everywhere) == 1 and own is None


def pages(spark):
    rows = []
    for k in range(120):
        w = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
        name = f"Site {'ABCDEF'[k % 6]} College"
        body = [f"# Guidance {w(k)}", "", f"Paragraph {w(k)} speaks of cookies and privacy in its own words number {w(k * 13)}.", "", "## Scope", "", f"- Item {w(k)}", f"Rule {w(k * 7)} applies to {w(k + 3)} as well."]
        top = ["Skip to main content", "Home | News | Library | Study"] if k % 2 else ["Log in", "News | Study | Home | Jobs | Library"]
        side = ["Related pages", f"› Guidance {w(k * 3)}", f"Guidance {w(k + 1)}"] if k % 3 == 0 else []
        end = [f"© {2000 + k} {name}. All rights reserved.", f"Tel. +00 {k}"]
        lines = [*top, "", *body, "", *(side + [""] if side else []), *end]
        rows.append((k, "\n".join(lines), f"https://{'abcdef'[k % 6]}.example/{k}", f"Guidance {w(k)} | {name}" if k % 4 == 0 else f"Guidance {w(k)}", "html", len(top), len(lines)))
    rows += [(900, None, None, None, "html", 0, 0), (901, "", "x", "t", "html", 0, 0), (902, "Log in\nHome", "https://a.example", None, "pdf", 0, 0)]
    return spark.createDataFrame(rows, "policy_doc_id long, text string, url string, title string, extension string, top int, n int")


def test_template_aligns_in_order():
    t = boilerplate.Template()
    for page in ([1, 2, 3, 4], [1, 2, 9, 4], [1, 4, 2], [5, 1, 2, 2, 4]):
        t.add(page)
    nodes = sorted(zip(t.rank, t.key, t.pages, t.again))
    # 4 before 2 has its own place; 3 and 9 mismatch between 2 and 4; 5 is an option at the top; 2 repeats
    got = [(k, n) for _, k, n, _ in nodes]
    assert got[:4] == [(5, 1), (1, 4), (4, 1), (2, 4)] and sorted(got[4:6]) == [(3, 1), (9, 1)] and got[6] == (4, 3)
    assert sum(a for *_, a in nodes) == 1
    long = boilerplate.Template()
    for k in range(300):
        long.add([0, 1000 + k, 1])
    # what mismatches between the same two nodes is one slot
    assert len(set(long.rank)) == 3 and long.pages[long.key.index(0)] == long.pages[long.key.index(1)] == 300
    order = long.rank[:]
    long._renumber()
    assert sorted(set(long.rank)) == [0, 1, 2] and np.array_equal(np.argsort(order, kind="stable"), np.argsort(long.rank, kind="stable"))


def test_small_host_in_a_large_pool(spark):
    """Its furniture is found however many pages others have, in parts and beside the pages as well as by broadcast."""
    word = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    rows = [(k, f"Line {word(k)} of its own\n\nAnother {word(k * 7 + 1)} goes on for a while", f"https://h{k % 7}.example/", None, "html") for k in range(12000)]
    rows += [(20000 + k, f"Ask the desk\n\nPage {word(k)} says something else\n\nOpen from nine to five", "https://small.example/", None, "html") for k in range(60)]
    df = spark.createDataFrame(rows, "policy_doc_id long, text string, url string, title string, extension string")
    want = {(20000 + k, no) for k in range(60) for no in (0, 4)}
    assert {(r.policy_doc_id, r.line_no) for r in boilerplate.furniture_lines(df).collect()} == want
    few, together = boilerplate.BROADCAST_ROWS, boilerplate.TOGETHER
    boilerplate.BROADCAST_ROWS, boilerplate.TOGETHER = 1, 25
    try:
        got = {(r.policy_doc_id, r.line_no) for r in boilerplate.furniture_lines(df).collect()}
    finally:
        boilerplate.BROADCAST_ROWS, boilerplate.TOGETHER = few, together
    assert got == want


def test_furniture(spark):
    df = pages(spark)
    got = {(r.policy_doc_id, r.line_no) for r in boilerplate.furniture_lines(df).collect()}
    true = set()
    for r in df.where("top > 0").collect():
        lines = r.text.split("\n")
        true |= {(r.policy_doc_id, i) for i in range(r.top)} | {(r.policy_doc_id, r.n - 1), (r.policy_doc_id, r.n - 2)}
        if "Related pages" in lines:
            at = lines.index("Related pages")
            true |= {(r.policy_doc_id, at + i) for i in range(3)}
    assert got == true
    body = {r.policy_doc_id: r for r in boilerplate.main_content(df).collect()}
    assert body[4].body.startswith("# Guidance e\n") and body[4].main_title == "Guidance e" and "Tel." not in body[4].body
    nodes = {(r.host, r.part, r.token): r for r in boilerplate.host_wrappers(df).collect()}
    login = nodes["a.example", "constant", "Log in"]
    assert (login.n_pages, login.of_pages) == (20, 20) and login.place == 0.0 and nodes["a.example", "head", "Related pages"].n_pages == 20 and nodes["a.example", "link", None].n_pages == 20
    assert boilerplate.furniture_lines(df.limit(0)).count() == 0


def test_long_furniture_is_no_context_of_its_own_pages(spark):
    low = lambda x: min((f"{x} of number {'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]} on all the pages of this site." for k in range(100)), key=boilerplate._hash)
    notices = [low("We use cookies to improve this page and to read the habits"), low("Any use of these pages is at the risk and at the cost")]
    rows = []
    for k in range(40):
        w = "abcdefghij"[k // 10] + "klmnopqrst"[k % 10]
        long = f"The {w} committee reads every report that the {w} office hands in before the end of its {w} term."
        rows.append((k, f"{notices[0]}\n\n{long}\n\nSee {w}."))
        rows.append((100 + k, f"{notices[0]}\n\nRule {w} holds for {w}.\n\n{notices[1]}"))
    # copies of one page, each slightly changed, under a notice
    body = [f"Part {x} of the text says at some length what the {x} rule of the house means for {x} students." for x in ("red", "blue", "green", "white")]
    rows += [(200 + k, "\n\n".join([notices[0], *body[: k % 4], f"Here the copy {'abcdefgh'[k]} has another line than all the copies beside it.", *body[k % 4 :]])) for k in range(8)]
    df = spark.createDataFrame([(k, t, f"https://a.example/{k}", None, "html") for k, t in rows], "policy_doc_id long, text string, url string, title string, extension string")
    got = {(r.policy_doc_id, r.line_no) for r in boilerplate.furniture_lines(df).collect()}
    assert got == {(k, 0) for k, _ in rows} | {(100 + k, 4) for k in range(40)}


def test_furniture_of_one_host_in_a_large_corpus(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "TOGETHER", 4)
    word = lambda n: "".join("abcdefghij"[int(c)] for c in str(n))
    text = lambda k, top: f"{top}\n\nThe {word(k)} committee reads every report of the {word(k * 7)} office before term {word(k + 9)} ends.\n\nSee {word(k)} too."
    own = "Write to the Harbour Campus help desk"
    rows = [(k, text(k, "Log in" if k % 2 else "Contact"), f"https://h{k % 97}.example/{k}") for k in range(9000)]
    rows += [(10000 + k, text(10000 + k, own) + (f"\n\n{own} Log in" if k == 0 else ""), f"https://harbour.example/{k}") for k in range(5)]
    # as often, on as many hosts: no furniture of any of them
    rows += [(20000 + k, text(20000 + k, "A phrase that five hosts share"), f"https://h{k}.example/x{k}") for k in range(5)]
    df = spark.createDataFrame([(k, t, u, None, "html") for k, t, u in rows], "policy_doc_id long, text string, url string, title string, extension string")
    got = {(r.policy_doc_id, r.line_no) for r in boilerplate.furniture_lines(df).collect()}
    assert got == {(k, 0) for k in range(9000)} | {(10000 + k, 0) for k in range(5)} | {(10000, 6)}


def coded(spark, n=500):
    rng = np.random.default_rng(2)
    skill = {"good1": 0.95, "good2": 0.95, "good3": 0.9, "weak1": 0.5, "weak2": 0.5, "spam": 0.0, "copy1": 0.35, "copy2": 0.35, "copy3": 0.35}
    rows, true = [], {}
    for i in range(n):
        t = {d: int(rng.random() < 0.4) for d in consensus.THEMES}
        s = {u: int(rng.integers(-2, 3)) if rng.random() < 0.5 else 0 for u in consensus.USES}
        true[f"c{i}"] = t | s
        copied = None
        for name in ["copy1", "copy2", "copy3"] + list(rng.choice(list(skill)[:6], 4, replace=False)):
            truthful = lambda: rng.random() < skill[name]  # noqa: B023, E731
            a = {d: v if truthful() else int(rng.random() < 0.5) for d, v in t.items()}
            b = {u: v if truthful() else int(rng.integers(-2, 3)) for u, v in s.items()}
            if name.startswith("copy"):
                copied = copied or (a, b)
                a, b = copied
            rows.append((f"c{i}", name, 1, f"2026-01-01T00:00:{i % 60:02d}Z", True, a, b))
    themes = "struct<" + ",".join(f"{d}:int" for d in consensus.THEMES) + ">"
    uses = "struct<" + ",".join(f"{u}:int" for u in consensus.USES) + ">"
    extra = [("c0", "good1", 1, "2025-01-01T00:00:00Z", True, {d: 1 for d in consensus.THEMES}, {u: 2 for u in consensus.USES}), ("c0", "good1", 1, "2027-01-01T00:00:00Z", False, None, None), (None, "good1", 1, None, True, rows[0][5], rows[0][6]), ("solo", "good1", None, None, True, {d: None for d in consensus.THEMES}, None)]
    return spark.createDataFrame(rows + rows[:50] + extra, f"chunk_id string, model_name string, seed int, timestamp_utc string, ok boolean, themes {themes}, sentiment {uses}"), true


def test_consensus_resists_copies_and_spam(spark):
    df, true = coded(spark)
    labels_, trust = consensus.infer(df)
    rows = labels_.collect()
    assert len({(r.chunk_id, r.dimension) for r in rows}) == len(rows) == 12 * 501
    right = np.mean([r.label == true[r.chunk_id][r.dimension] for r in rows if r.chunk_id != "solo"])
    assert right > 0.9
    by = trust.groupBy("model_name").avg("competence", "dependence").toPandas().set_index("model_name")
    assert by.loc["good1"].iloc[0] > 0.8 > 0.35 > by.loc["spam"].iloc[0] and by.loc["copy1"].iloc[1] > 0.7 > 0.4 > by.loc["good1"].iloc[1]
    solo = [r for r in rows if r.chunk_id == "solo"]
    assert all(r.label == 0 and r.agreement is None and r.n_annotators == 1 for r in solo)
    assert labels_.where("n_annotators >= 3").count() == consensus.infer(df, least=3)[0].count()


def test_consensus_of_nothing(spark):
    df, _ = coded(spark, 1)
    labels_, trust = consensus.infer(df.limit(0))
    assert labels_.count() == trust.count() == 0


RESIDUE = ["Students must {{tool_name}} the tasks.", "The %%POLICY_NUMBER%% rule applies to all.", "404 – Page not found\nThe page you requested could not be found.", "You need to enable JavaScript to run this app.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.", "Rules\n\n[insert link] applies.", "このページを表示するにはJavaScriptを有効にしてください。", "Content coming soon.", "Error! Reference source not found."]
PLAIN = ["Links made up by tools often end in a 404 error, so students should check.", "Dummy text such as lorem ipsum is no evidence of anything.", "A sample statement reads: “I used [name of tool] on [date] to [describe purpose].”", "<|im_start|>system\nYou code passages.<|im_end|>", "In this course JavaScript exercises may be enabled with care.", "A page that says ‘under construction’ counts as missing."]


@pytest.mark.parametrize("extra", ["", "x" * 200_000, "some words of a very long text " * 150_000])
def test_residue(spark, extra):
    """Marks are found wherever they stand; a notice without a mark once it recurs, by the places it stands at."""
    rows = [(k, f"{SENTENCES['en'][k % 2]} {PLAIN[k % 6]}\n{SENTENCES['de'][k % 2]}", "s") for k in range(300)]
    notices = [t for t in RESIDUE if not residue.trusted_spans(t)]
    assert len(notices) == 4
    rows += [(1000 + k, t, "s") for k, t in enumerate(RESIDUE)] + [(2000 + k, t, "s") for k, t in enumerate(PLAIN)] + [(3000, None, "s"), (3001, "", "s"), (3002, " \n", "s"), (3003, f"plain {extra}", "s"), (1000, RESIDUE[0], "s")]
    # each alone, with another line, and beside a mark
    rows += [(4000 + 10 * k + j, (t, f"{t}\nOffice", f"{t}\n%%PAGE_NAME%%")[j % 3], "s") for k, t in enumerate(notices) for j in range(6)]
    rows += [(5000, f"{SENTENCES['en'][0]} {SENTENCES['en'][1]}\n{notices[1]}", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    want = {1000 + k for k in range(len(RESIDUE))} | {4000 + 10 * k + j for k in range(4) for j in range(6)} | {5000}
    assert {r.doc_id for r in residue.find_residue(df).collect()} == want
    assert residue.find_residue(df.limit(0)).count() == 0


def test_a_very_long_unit_scores_as_its_parts():
    three, one = np.ones((8, langid.SIZE)), np.ones((8, langid.SIZE))
    three[:, ::7] += np.arange(8)[:, None]
    model = langid.NGrams(three, one)
    unit = "words of a text " * 70_000
    parts = [unit[at : at + langid.BLOCK] for at in range(0, len(unit), langid.BLOCK)]
    assert np.allclose(model.score(["short", unit])[1], model.score(parts).sum(axis=0), rtol=1e-4)
