"""Personal data: values by brute force over the plain patterns, revealing terms by brute force over all observations."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from tests.llm.edge import no_documents, odd_documents
from vitrine.llm import privacy, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, x):
    digits = [int(c) for c in x if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(d * 2, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain_values(text):
    return [(kind, *m.span()) for kind, pattern in PLAIN.items() for m in re.finditer(pattern, text) if passes(kind, m[0])]


def test_values_by_brute_force():
    rnd = random.Random(3)
    bits = ["a", "é", "@", ".", "-", "+", "1", "25", "256", "0", " ", "(", ")", "\n", "a.b@c.de", "10.0.0.1", "4539578763621486", "4539 5787 6362 1486", "+1 (743) 555-3824", "x@y", "..", "漢", "1.2.3", "00000255.1.1.1", "%", "_"]
    for _ in range(20_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 12)))
        assert [f[:3] for f in privacy.values(text)] == plain_values(text), text


def test_values_take_linear_time():
    began = time.perf_counter()
    for text in ("x" * 2_000_000, "1" * 2_000_000, "1." * 700_000, "a@" * 700_000, "+1" * 700_000, "+1" + "." * 2_000_000, "1-" * 700_000, "x" * 1_000_000 + "@y.z"):
        privacy.values(text)
    assert time.perf_counter() - began < 20


def test_long_numbers_are_judged():
    assert privacy.values("9" * 6000 + ".1.1.1") == [] and [f[:3] for f in privacy.values("0" * 6000 + "9.1.1.1")] == [("ip", 0, 6007)]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_form(kind, x):
    return x.lower() if kind == "email" else ".".join(str(int(p)) for p in x.split(".")) if kind == "ip" else re.sub("[^0-9]", "", x)


def brute_terms(texts, window, threshold, stem):
    """The whole operator over lists: {row: {(start, end): instead}}."""
    counts = Counter(w for t in texts for w in TERM.findall(lower(t)))
    stems = Counter()
    for w, n in counts.items():
        stems[w[:stem]] += n
    n_all, seen = sum(counts.values()), []
    for row, text in enumerate(texts):
        found = plain_values(text)
        covered = {i for _, a, b in found for i in range(a, b)}
        masked = "".join("\n" if i in covered else c for i, c in enumerate(lower(text)))
        terms = [(m.start(), m.end(), m[0]) for m in TERM.finditer(masked)]
        places = set()
        for kind, a, b in found:
            entity = (kind, plain_form(kind, text[a:b]))
            near = [t for t in terms if t[0] < a][-window:] + [t for t in terms if t[0] >= a][:window]
            context = tuple(t[2] for t in near)
            for start, end, term in near:
                if (entity, start) not in places:
                    places.add((entity, start))
                    seen.append((row, entity, term, start, end, context))
    n_e = Counter(o[1] for o in seen)

    def told(key, of):
        n, contexts = Counter(), defaultdict(set)
        for _, e, t, *_, c in seen:
            n[e, key(t)] += 1
            contexts[e, key(t)].add(c)
        out = {}
        for (e, k), m in n.items():
            content, s = math.log2(n_all / n_e[e]), len(contexts[e, k])
            out[e, k] = (content + math.log2(m / max(of[k], m))) / content * (s / (s + 1)) ** 2 if content > 0 else 0
        return out

    terms, by_stem = told(lambda t: t, counts), told(lambda t: t[:stem], stems)
    result = defaultdict(dict)
    for row, e, t, a, b, _ in seen:
        if terms[e, t] > threshold:
            instead = "" if len(t) <= stem or by_stem[e, t[:stem]] > threshold else t[:stem] + "*"
            result[row][a, b] = min(instead, result[row].get((a, b), instead))
    return result


def corpus():
    """People with addresses and names that stand near them, in filler of common words; one name also elsewhere, one address very often."""
    rnd = random.Random(5)
    filler = ["the", "and", "report", "meeting", "about", "from", "marble", "quick", "with", "office", "Zeppelin", "zephyr"]
    words = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    people = [("Quillon", "q.one@mail.example.com"), ("Zepworth", "+1 (743) 555-3824"), ("Marwick", "10.20.30.40"), ("Common", "4539578763621486"), ("Solo", "solo@a.example.org"), ("Ünal", "Hot@b.example.org")]
    texts = [words(120) for _ in range(40)]
    for name, value in people:
        for _ in range({"Solo": 1, "Ünal": 60}.get(name, 6)):
            texts.append(f"{words(12)} {name} {words(2)}, {value} {words(14)} {value.upper() if name == 'Ünal' else words(2)}")
    texts += [f"{words(10)} common {words(5)}" for _ in range(60)]
    texts += [texts[-1], "Solo solo@a.example.org end"] + ["Copied person Vexley x.y@c.example.net near " + words(9)] * 1 
    return texts + [texts[-1]] * 5


def test_terms_by_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for window, threshold, stem in ((8, 0.5, 3), (3, 0.2, 2), (20, 0.6, 3)):
        want = brute_terms(texts, window, threshold, stem)
        found = {r.doc_id: {(t.start, t.end): t.instead for t in r.pii_terms} for r in privacy.spans(docs, ["doc_id"], window, threshold, stem).collect()}
        assert {k: v for k, v in found.items() if v} == dict(want)
    named = {texts[row][a:b] for row, at in brute_terms(texts, 8, 0.5, 3).items() for a, b in at}
    assert {"Quillon", "Zepworth", "Marwick", "Ünal"} <= named and not {"Common", "Vexley", "the", "report", "Solo"} & named


def test_sanitised_texts(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    found = {r.doc_id: r for r in privacy.sanitised(docs).collect()}
    assert len(found) == len(texts) and all(r.pii == "kept" for r in found.values())
    joined = "\n".join(r.text for r in found.values())
    assert "Quillon" not in joined and "@" not in joined and "555" not in joined and "[email]" in joined and "[phone]" in joined
    assert "zep*" in joined  # other words begin alike, so the stem alone tells little
    assert [found[i].text for i in range(40)] == texts[:40]


def test_overlapping_spans_are_replaced_once():
    assert privacy.replaced("abcdef", [(1, 3, "[x]"), (2, 5, "[y]")]) == "a[x]f"


def test_query_digests(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (7, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_private_terms(spark, str(tmp_path)).collect()
    terms = brute_terms(texts, 8, 0.5, 3)
    assert len(rows) == len(texts) + 2 and rows[0].asDict().keys() == {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}
    for r in rows:
        if r.doc_id is None or (r.doc_id == 7 and not r.spans):
            assert r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
            continue
        base = [f"{k}:{a}:{b}" for k, a, b in plain_values(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans == ",".join(base + [f"term:{a}:{b}" for a, b in sorted(terms.get(r.doc_id, ()))])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k + ":") for x in base) for k in privacy.KINDS)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    found = privacy.spans(docs, ["doc_id"]).collect()
    assert len(found) == docs.count() and all(r.pii_base == "" and r.pii_terms == [] for r in found)
    same = privacy.sanitised(docs)
    assert same.columns == docs.columns and same.exceptAll(docs).count() == 0 and docs.exceptAll(same).count() == 0
    assert privacy.spans(no_documents(spark), ["doc_id"]).collect() == [] and privacy.sanitised(no_documents(spark)).count() == 0
