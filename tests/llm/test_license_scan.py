import re

import pytest

from cinder.llm import license_scan as ls
from cinder.llm.catalog import op2_license_scan

AUTOMATON = ls.TemplateAutomaton(ls.TEMPLATES)


def labels(text):
    return sorted({m[0] for m in AUTOMATON.matches(ls.words_of(text))})


@pytest.mark.parametrize(("text", "want"), [
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("licensed under a CC-BY 3.0", ["cc-by"]),
    ("Licensed under CC BY-NC.", []),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl"]),
    ("licensed under the GNU Lesser General Public License", ["gpl"]),
    ("licensed under the GNU really lesser General Public License", []),
    ("Copyright (c) 2020 Some Person. All rights reserved", ["reserved"]),
    ("All rights  reserved", ["reserved"]),
    ("All the rights reserved", []),
    ("RELEASED UNDER THE MIT LICENSE", ["mit"]),
    ("released under the mitt license", []),
    ("Licensed under the Apache License, Version 2.0", ["apache-2.0"]),
    ("Licensed under the Apache License, Version 1.0", []),
])
def test_mandatory_wording_must_match_exactly(text, want):
    assert labels(text) == want and labels(f"one two {text} three") == want


def test_markup():
    a = ls.TemplateAutomaton([("x", "begin {{gap:1-2}} [[maybe [[so]]]] end #")])
    ok = ["begin a end 1", "begin a b end 22", "begin a maybe end 3", "begin a maybe so end 3", "begin a b maybe so end 3"]
    bad = ["begin end 1", "begin a b c end 1", "begin a b so end 1", "begin a end x", "begin a b maybe maybe end 1"]
    for t, want in [(t, True) for t in ok] + [(t, False) for t in bad]:
        assert bool([m for m in a.matches(ls.words_of(t)) if m[1] == 0]) == want, t
    with pytest.raises(ValueError):
        ls.TemplateAutomaton([("x", "a [[b")])


BODIES = [(label, t) for label, t in ls.TEMPLATES if len(t.split()) > 25]


def written_out(template, word="acme"):
    """A text that the template accepts: no optional region, the least number of replaced words."""
    while "[[" in template:
        template = re.sub(r"\[\[[^\[\]]*\]\]", "", template)
    return re.sub(r"\{\{\w+:(\d+)-\d+\}\}", lambda m: " ".join([word] * int(m[1])), template).replace("#", "3").split()


@pytest.mark.parametrize(("label", "template"), BODIES)
def test_whole_licence_texts_must_match_to_the_end(label, template):
    text = written_out(template)
    whole = lambda ws: {m[0] for m in AUTOMATON.matches(ls.words_of(" ".join(ws))) if m[2] - m[1] == len(text)}
    assert whole(text) == {label}
    for at in range(0, len(text), max(1, len(text) // 12)):
        if text[at] in ("acme", "3"):
            continue
        changed = [*text[:at], "except", *text[at + 1:]]
        assert not whole(changed), (label, text[at])                       # a word of the wording replaced
    assert not whole(text[:-1])


def test_a_licence_with_a_changed_condition_is_not_that_licence():
    mit = next(t for label, t in BODIES if label == "mit")
    text = " ".join(written_out(mit))
    assert "mit" in labels(text)
    assert "mit" not in labels(text.replace("without restriction including", "without restriction except selling it including"))
    assert "mit" not in labels("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                               "documentation files the software to deal in the software without restriction except selling it")
    bsd2, bsd3 = (" ".join(written_out(t)) for label, t in BODIES if label.startswith("bsd"))
    assert labels(bsd2) == ["bsd-2-clause"] and labels(bsd3) == ["bsd-3-clause"]
    assert labels(bsd2.replace("must retain", "need not retain")) == []


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: r for r in op2_license_scan(spark, "/root/testdata/sf0.01").collect()}
    hits = 0
    for d in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), d.text)
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        base = [(label, i) for phrase, label in ls.PHRASES.items() for i in range(len(ws))
                if ws[i:i + len(phrase.split())] == phrase.split()]
        r, at = got[d.doc_id], [i for _, i in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(base), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({b for b, _ in base}))
        assert r.labels == ",".join(sorted({b for b, _ in base} | set(labels(d.text))))
        hits += len(base)
    assert hits > 10 and len(got) == len(docs)


def test_odd_rows(odd_docs, odd_rows, empty_docs, clashing_docs):
    got = ls.scan(clashing_docs).collect()
    assert len(got) == len(odd_rows)
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[i].n_words, by_id[i].labels, by_id[i].score) for i in (1, 2, 3)] == [(0, "", 0.0)] * 3
    assert by_id[6].n_words == 60_000 and ls.scan(empty_docs).count() == 0
