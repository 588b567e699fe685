"""Personal data planted in texts; what looks like it but isn't."""

import pytest

from kinolith.llm import mentions as M
from kinolith.llm import privacy as P

SF = "/root/testdata/sf0.01"
PLANTED = [
    ("Contact: {Mozet Wexiano}, {kaquil+scenes@mail.dunlinbox.example}, {(854) 555-0112}", "person email phone"),
    ("signed, Dr. {Lindenko}\nthe reels are kept at {Flat 13, 223A Bramwick Close}, then", "person address"),
    ("For payment we hold SSN {929-69-6833} of {Tasy J. Bravstowe}.", "id_number person"),
    ("Rückruf unter {030/23125583} bis Freitag. Das Archiv liegt in der {Weidengasse 38a}.", "phone address"),
    ("im Formular Steuer-ID {00 658 397 221}. Contacto: {Caldthorpe, Kamara}, {+34 579 69 43 76}", "id_number person phone"),
    ("Les croquis sont au {77 bis avenue de l'Écluse}. Los dibujos se guardan en {Calle Ribera, 105}.", "address address"),
    ("write to {mozet.tharborough} [at] stickloft [dot] example or {tamara31}＠post.dunlinbox.test now", "email email"),
    ("Call  {+1  525  555  0155}  if  the  render  hangs.", "phone"),
]
NOTHING = [
    "Take 966-82 replaces clip 06-370-7481. Rendered at 640x480, 30 fps, seed 1793661674.", "Export sprite32@2x.png and tag @pell in the review.",
    "@ 13 t5 33 45 r1 82", "see build 2025.8.104. Ticket RUN-8498796: polished prop", "Verel said the bell needs 7 more frames.", "Pell should dance at 8.1s, not at 10.3s.",
    "The working title is Paper Harbour.", "00:00:02,768 --> 00:00:04,983", "", " ",
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/name_list.parquet")


def test_planted_mentions_and_placeholders(spark, corpus):
    documents, names = corpus
    rows, want = [], {}
    for i, (marked, kinds) in enumerate(PLANTED):
        text, at, starts = "", 0, []
        for c in marked:
            if c == "{":
                starts.append(at)
            elif c != "}":
                text += c
                at += 1
        rows.append((-1 - i, text))
        want[-1 - i] = sorted(zip(starts, kinds.split()))
    rows += [(-100 - i, t) for i, t in enumerate(NOTHING)] + [(-200, None)]
    planted = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = P.find(documents.unionByName(planted), names, masked=True).where("doc_id < 0").collect()
    texts = dict(rows)
    for r in found:
        got = sorted((m.start_at, m.kind) for m in r.mentions)
        assert got == want.get(r.doc_id, []), (texts[r.doc_id], got)
        if texts[r.doc_id] is None:
            assert r.text is None
        else:
            rest, last = [], 0
            for m in r.mentions:
                rest += [texts[r.doc_id][last : m.start_at], f"[{m.kind.upper()}]"]
                last = m.end_at
            assert r.text == "".join([*rest, texts[r.doc_id][last:]])
    assert len(found) == len(rows)


def test_strict_labels_agree_with_the_model_on_documents_it_was_not_fitted_on(spark, corpus):
    documents, names = corpus
    listed = names.collect()
    lexicon = M.Lexicon([r.word for r in listed if r.name_kind == "given"], [r.word for r in listed if r.name_kind == "family"])
    texts = [r.text for r in documents.where("text IS NOT NULL").orderBy("doc_id").collect()]
    model = P.fit_model(texts[::2], lexicon)
    graph = P.Graph([M.candidates(M.fold(t), lexicon) for t in texts[1::2]])
    labels = [P._label(c) for c in graph.nodes]
    pairs = [(a, b) for a, b in zip(labels, model.decode(graph)) if a is not None]
    assert sum(a == b for a, b in pairs) >= 0.98 * len(pairs)


def test_scans_are_linear_and_an_empty_table(spark, corpus):
    _, names = corpus
    lexicon = M.Lexicon(["Mozet"], ["Wexiano"])
    for text in ("a" * 300_000, "1 " * 150_000, "a.b-" * 80_000, "@" * 100_000, "Mozet Wexiano " * 20_000):
        M.candidates(text, lexicon)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert P.find(empty, names).collect() == []
