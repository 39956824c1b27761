import re
import textwrap

import duckdb
from compare import duck_rows, spark_rows
from helpers import CAPITALS, frame
from paths import SF_CHECKED

from leadcurve.llm import licenses as li
from leadcurve.llm import oracle, queries

WORD = re.compile(li.WORD)


def plain(text):
    found, places = WORD.findall((text or "").translate(CAPITALS)), []
    for phrase, label in li.PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(found)) if found[i : i + len(parts)] == parts]
    matches = []
    for (label, template), span in zip(li.TEMPLATES, li.spans(li.TEMPLATES), strict=True):
        wanted = set(li.words_of(template))
        hits = [(i, len(wanted.intersection(found[i : i + span]))) for i, w in enumerate(found) if w in wanted]
        hits = [(i, n) for i, n in hits if n >= li.THRESHOLD * len(wanted) - 1e-9]
        for (before, _), (i, _) in zip([(-span, 0), *hits], hits, strict=False):
            if i - before >= span:
                matches.append((i, label, max(n for j, n in hits if i <= j < i + span) / len(wanted)))
    base = {label for _, label in places}
    score = max([c for _, _, c in matches], default=1.0 if places else 0.0)
    return len(found), sorted(places), sorted(base), sorted(base | {label for _, label, _ in matches}), sorted(set(matches)), score


def result(df):
    return {
        r.doc_id: (r.n_words, sorted((p.at, p.label) for p in r.places), r.base_labels, r.labels, sorted({(m.at, m.label, m.containment) for m in r.matches}), r.score)
        for r in df.collect()
    }


def test_plain_version(spark):
    texts = [t for _, t in li.TEMPLATES] + [t.upper() + "\nmore" for _, t in li.TEMPLATES]
    texts += [" ".join(t.split()[:-1]) for _, t in li.TEMPLATES] + [" ".join(t.split()[2:]) + " extra" for _, t in li.TEMPLATES]
    texts += ["GNU\nGeneral - public, LICENSE gnu general public license", "cc\x80by cc by, cc-by ccby cc by", "the mit  license MIT.License; apache licenses Apache license", None, "", " . ", "É1 x", "licensed under the mit license " * 3000]
    texts += ["Licensed under CC BY 4.0", "Licensed under the License, Version 2.0", "Apache License Version under the Licensed 2.0 and more words"]
    docs = frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    assert result(li.scan(docs)) == {i: plain(t) for i, t in enumerate(texts)}


def test_driver_documents(spark):
    docs = spark.read.parquet(f"{SF_CHECKED}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = result(li.scan(docs))
    assert got == {i: plain(t) for i, t in texts.items()}
    assert sum(bool(r[3]) for r in got.values()) > 20


def test_repeats_nulls_and_extra_columns(spark):
    rows = [(1, "the MIT license", "a", "b"), (1, "the MIT license", "a", "b"), (1, "nothing", "a", "b"), (None, "Released under the MIT License", "a", "b"), (None, None, None, None)]
    docs = frame(spark, rows).selectExpr("*", "1 as words", "2 as token", "3 as places", "4 as own_id")
    got = sorted(((r.doc_id, r.n_words, r.labels, r.score) for r in li.scan(docs).collect()), key=repr)
    assert got == sorted([(1, 3, ["mit"], 1.0), (1, 3, ["mit"], 1.0), (1, 1, [], 0.0), (None, 5, ["mit"], 1.0), (None, 0, [], 0.0)], key=repr)
    assert li.scan(frame(spark, [])).collect() == []


def test_prefix_keeps_what_can_match():
    rows = li.template_rows(sorted({w for _, t in li.TEMPLATES for w in li.words_of(t)}), li.TEMPLATES, 0.9)
    for _, _, words, need, prefix in rows:
        assert len(words) - len(prefix) == need - 1


def wrapped():
    """Every template wrapped at any width, one word a line included, with comment marks, indents, blank lines and filler words."""
    rows, want = [], {}
    for number, (label, template) in enumerate(li.TEMPLATES):
        for k, (width, mark) in enumerate([(72, ""), (40, "# "), (24, " * "), (30, "\n// "), (1, "")]):
            body = [mark + line for line in textwrap.wrap(template, width, break_long_words=False)]
            rows.append((10 * number + k, "\n".join(["Some WORDS before.", "", *body, "", "Nothing comes after it."]), None, None))
            want[10 * number + k] = label
        filled = template.replace(" ", "\nxx yy ")
        rows += [(10 * number + 5, filled, None, None), (10 * number + 6, filled.replace("\n", " "), None, None)]
        want |= {10 * number + 5: label, 10 * number + 6: label}
    rows += [(900, "word " * 3000 + "\n" + "\n".join(textwrap.wrap(li.TEMPLATES[10][1], 70)), None, None), (901, li.TEMPLATES[10][1].replace(" ", "\nnothing of the kind stands here\n"), None, None)]
    return rows, want


def test_wrapped_notices(spark):
    """A notice is found however its lines end, and begins at its first word; one word in seven is too few on any lines."""
    rows, want = wrapped()
    rows.append((902, rows[-1][1].replace("\n", " "), None, None))
    got = {r.doc_id: r for r in li.scan(frame(spark, rows)).collect()}
    for i, label in want.items():
        assert label in got[i].labels and got[i].score >= 0.9, rows[i]
        if i % 10 < 5:
            assert (3, label) in {(m.at, m.label) for m in got[i].matches}, (i, got[i].matches)
    assert got[900].labels == ["mit"] and [m.at for m in got[900].matches] == [3000]
    assert got[901].labels == got[902].labels == []
    assert result(li.scan(frame(spark, rows))) == {i: plain(t) for i, t, _, _ in rows}


def test_sql_on_wrapped_notices(spark, tmp_path):
    rows, _ = wrapped()
    rows += [(2000, "Released under the MIT License. " + "filler " * 50 + "Released under the MIT License", None, None), (2001, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert spark_rows(queries.op9_licenses(spark, str(tmp_path))) == duck_rows(con, oracle.LICENSES_SQL)
