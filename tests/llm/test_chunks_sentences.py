from hypothesis import given, settings
from hypothesis import strategies as st

from stratoloom.llm.chunk_split import rechunk, split_oversized, split_points
from stratoloom.llm.sentences import segment, sentence_spans, split_sentences


def check(text, limit, overlap):
    pts = split_points(text, limit, overlap)
    assert pts[0][0] == 0 and pts[-1][1] == len(text)
    for (a, b), (c, d) in zip(pts, pts[1:]):
        assert a < c <= b < d or overlap == 0 and b == c
        if overlap:
            assert 1 <= b - c <= overlap
    assert all(len(text[a:b].encode()) <= limit for a, b in pts)
    return pts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é漢😀.\n ", max_size=400), st.integers(16, 60), st.integers(1, 8))
def test_pieces_cover_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_fall_on_boundaries():
    text = "\n".join(f"line {i} of the text" for i in range(100))
    for a, b in check(text, 300, 50)[:-1]:
        assert text[b - 1] == "\n"
    check("x" * 10_000, 4096, 200)
    check("漢" * 5_000, 4096, 200)
    check("aaé漢漢 漢😀", 16, 5)
    check("😀" * 9, 8, 8)
    assert split_points("", 10, 2) == [(0, 0)]


CH = "chunk_id long, file_id long, chunk_index int, content string, start_line int, end_line int, extra string"


def test_split_and_dense_index(spark):
    big = "\n".join("y" * 90 for _ in range(100))
    rows = [(1, 9, 0, "a", 1, 1, "e"), (2, 9, 1, big, 2, 101, None), (2, 9, 1, big, 2, 101, None), (3, 9, 2, None, None, None, ""), (4, None, 0, "z" * 5000, 7, 7, "q"), (None, 1, 1, big, 1, 1, "")]
    df = spark.createDataFrame(rows, CH)
    got = split_oversized(df).orderBy("chunk_id", "piece").collect()
    two = [r for r in got if r.chunk_id == 2]
    assert len(two) == two[0].pieces == 3 and two[0].start_line == 2 and two[-1].end_line == 101 and {r.long_lines for r in two} == {0}
    assert {r.long_lines for r in got if r.chunk_id == 4} == {1} and {r.chunk_id for r in got} == {2, 4}
    idx = sorted((r.chunk_index, r.chunk_id, r.piece) for r in rechunk(df, block=1).where("file_id = 9").collect())
    assert [i for i, *_ in idx] == list(range(5)) and [c for _, c, _ in idx] == [1, 2, 2, 2, 3]
    assert split_oversized(df.where("false")).count() == 0 and rechunk(df.where("false")).count() == 0


def cut(text):
    return [text[a:b] for a, b in sentence_spans(text)]


def test_spaced_scripts():
    assert cut("Dr. A. Smith paid 3.5 kg, vs. 4.2 kg. Why now? “No. It stays,” said Bob. Done!") == ["Dr. A. Smith paid 3.5 kg, vs. 4.2 kg.", "Why now?", "“No. It stays,” said Bob.", "Done!"]
    assert cut("The notes end with etc. Later pages follow. Too slow... far too slow.") == ["The notes end with etc.", "Later pages follow.", "Too slow... far too slow."]
    assert cut("Das gilt z. B. für den 3. Oktober. Der 2. Lauf endete. Laut Nr. 5 d. h. jetzt.") == ["Das gilt z. B. für den 3. Oktober.", "Der 2. Lauf endete.", "Laut Nr. 5 d. h. jetzt."]
    assert cut("Pourquoi ? « Laissez. Il sert », a dit M. Dupont. Fin !") == ["Pourquoi ?", "« Laissez. Il sert », a dit M. Dupont.", "Fin !"]
    assert cut("¿Por qué? ¡Pare! La Dra. Sol contó aprox. 5.") == ["¿Por qué?", "¡Pare!", "La Dra. Sol contó aprox. 5."]
    assert cut("डॉ. राम ने देखा। src/a.py में देखें। रोकें! src/b.py में है।") == ["डॉ. राम ने देखा।", "src/a.py में देखें।", "रोकें!", "src/b.py में है।"]
    assert cut("He said: “Stop.” Then left. (It moved in v1.2.) End.") == ["He said: “Stop.”", "Then left.", "(It moved in v1.2.)", "End."]


def test_spaceless_scripts():
    assert cut("Bob问：“在哪里？”用时3.5秒。“好了！”Ann这样写道。（完。）下一句……再来。") == ["Bob问：“在哪里？”", "用时3.5秒。", "“好了！”Ann这样写道。", "（完。）", "下一句……", "再来。"]
    assert cut("担当者は「問題ない。」とだけ書いた。「もう？」とXは尋ねた。版1.2では削除した。") == ["担当者は「問題ない。」とだけ書いた。", "「もう？」とXは尋ねた。", "版1.2では削除した。"]
    assert cut("ทีมงานย้ายแล้ว รุ่น1.2ตัดออก") == ["ทีมงานย้ายแล้ว", "รุ่น1.2ตัดออก"]
    assert segment("なぜと言った", frozenset(["と", "と言った"])) == ["な", "ぜ", "と言った"]


def test_particles_and_opening_words_decide_spaceless_gaps():
    assert cut("本当か？と彼は聞いた。とても驚いた。") == ["本当か？と彼は聞いた。", "とても驚いた。"]
    assert cut("本当か？とても驚いた。") == ["本当か？", "とても驚いた。"]
    assert cut("私は……東京へ行く。") == ["私は……東京へ行く。"]
    assert cut("行くよ……東京だ。") == ["行くよ……", "東京だ。"] and cut("行くよ……と言った。") == ["行くよ……と言った。"]
    assert cut("因为……下雨了。好吗……的确。") == ["因为……下雨了。", "好吗……", "的确。"]


def test_units():
    assert cut("# Head. Two\n\nA b\nc d.\n- one. two\n- three\n\nlast") == ["# Head. Two", "A b\nc d.", "- one. two", "- three", "last"]
    assert cut(None) == cut("") == cut(" \n ") == []
    assert cut("\n  lead. Next.  \n") == ["lead.", "Next."]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB.!? \n“”\"()-漢。「」ก", max_size=120))
def test_spans_are_ordered_and_lose_no_text(text):
    spans = sentence_spans(text)
    at = 0
    for a, b in spans:
        assert at <= a < b and not text[a].isspace() and not text[b - 1].isspace() and not text[at:a].strip()
        at = b
    assert not text[at:].strip()


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", "x"), (2, None, "y"), (3, "", "z"), (1, "A b. C d.", "x"), (None, "E.", "w")], "doc_id long, text string, sentence string")
    got = sorted((str(r.doc_id), r.sentence, r.start_char, r.end_char, r.text) for r in split_sentences(df, with_text=True).collect())
    assert got == sorted([("1", 0, 0, 4, "A b."), ("1", 1, 5, 9, "C d."), ("1", 0, 0, 4, "A b."), ("1", 1, 5, 9, "C d."), ("None", 0, 0, 2, "E.")])
    assert split_sentences(df.where("false")).count() == 0
    long = "Word one two. " * 50_000
    assert len(sentence_spans(long)) == 50_000


def test_costs_decide_open_gaps_of_spaced_scripts():
    from stratoloom.llm.sentences import sentence_spans

    cut = lambda t: [t[a:b] for a, b in sentence_spans(t)]
    # the same abbreviation before a name, before an opening word, and at the end
    assert cut("The U.S. Army came. It left.") == ["The U.S. Army came.", "It left."]
    assert cut("He lives in the U.S. The weather is fine.") == ["He lives in the U.S.", "The weather is fine."]
    assert cut("See plan B. The next one is C. Smith wrote it.") == ["See plan B.", "The next one is C. Smith wrote it."]
    assert cut("We use cats, dogs, etc. The rest is old. Deanwuk Inc. sold it.") == ["We use cats, dogs, etc.", "The rest is old.", "Deanwuk Inc. sold it."]
    # a piece without a word is not worth an end of its own
    assert cut("A. Then it came.") == ["A. Then it came."] and cut("Plan A. Then it came.") == ["Plan A.", "Then it came."]
