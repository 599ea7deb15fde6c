"""Base spans against plain regular expressions; contexts on planted identifiers."""

import hashlib
import random
import re

from tests.llm.conftest import FOLDER, documents
from tracemill.llm import pii, queries_text

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    worth = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(w - 9 if w > 9 else w for w in worth) % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def shown(spans):
    return ",".join(f"{pii.KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def same(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [tuple(s) for s in r["base"]] == want, texts[r["doc_id"]][:200]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(o == i for _, o, _ in want) for i in range(4)]
        assert set(want) <= {tuple(s) for s in r["spans"]}


def test_base_against_regular_expressions(spark_llm):
    pick = random.Random(9)
    parts = ["a@b.c", "@", ".", "-", "+1", " ", "(", ")", "12", "4111 1111 1111 1111", "4111-1111-1111-1111", "255.1.2.3", "256.1", "é", "😀", "\n", "x", "%", "555", "a@", "b.", "\uf8ff", "0001"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randrange(25))) for _ in range(1500)]
    texts += [None, "", "1" * 100_000, "a.b" * 30_000, "x@" + "a." * 30_000, "1 " * 50_000, "+1" + "(" * 50_000, "a@b.c " * 500]
    same(pii.find_personal_data(documents(spark_llm, texts, base=["x"] * len(texts))).collect(), texts)


def test_query_base(spark_llm):
    texts = {r["doc_id"]: r["text"] for r in spark_llm.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for r in queries_text.contextual_pii(spark_llm, FOLDER).collect():
        want = shown(brute(texts[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert not want or set(want.split(",")) <= set(r["spans"].split(","))


def test_contexts_find_more(spark_llm):
    texts = [f"please call me +1 (200) 555-{1000 + i} today" for i in range(0)]
    texts += [f"his private address: 10.{i}.7.4444 or 10.{i}.7.44" for i in range(3)]
    texts += [f"my secret card: 4111{i:04d}0000{d} then" for i in range(6) for d in range(1000, 1100) if luhn(f"4111{i:04d}0000{d}")]
    texts += ["my secret card: 41112222 then", "some other word 41112222 then", "my secret card: 4111"]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark_llm, texts)).collect()}
    spans = {i: [tuple(s) for s in rows[i]["spans"]] for i in rows}
    last = len(texts)
    assert spans[last - 3] == [(16, 2, 24)] and rows[last - 3]["n_card"] == 0
    assert spans[last - 2] == [] and spans[last - 1] == [(16, 2, 20)]
    assert pii.find_personal_data(documents(spark_llm, [])).count() == 0


def test_every_kind_of_seed_teaches_its_context(spark_llm):
    texts = [f"please ring home +1 (200) 555-{1000 + i} today" for i in range(8)]
    texts += [f"write to jane.doe{i}@example.org now" for i in range(8)]
    texts += [f"the server listens at 10.3.{i}.44 again" for i in range(8)]
    texts += [f"paid by card 4111 1111 {i:04d} {d:04d} then" for i in range(3) for d in range(60) if luhn(f"41111111{i:04d}{d:04d}")]
    unseen = [
        ("please ring home (838) 555-7235 today", (17, 3, 31)),
        ("please ring home 55 72 35 today", (17, 3, 25)),
        ("please write to jane(at)example.org now", (16, 0, 35)),
        ("please write to jane at example dot org now", (16, 0, 39)),
        ("the server listens at fe80::1 again", (22, 1, 29)),
        ("paid by card 4111 1111 1111 1112 then", (13, 2, 32)),
    ]
    plain = ["please ring the bell 12 times", "some jane(at)example.org now"]
    rows = {
        r["doc_id"]: [tuple(s) for s in r["spans"]]
        for r in pii.find_personal_data(documents(spark_llm, [*texts, *[text for text, _ in unseen], *plain])).collect()
    }
    assert [rows[len(texts) + i] for i in range(len(unseen))] == [[span] for _, span in unseen]
    assert [rows[len(texts) + len(unseen) + i] for i in range(len(plain))] == [[], []]


def test_candidates_stand_outside_base_values(spark_llm):
    text = "12 or +1 (200) 555-1000 or 7\uf8fd7 id5 x@y.z,q9 and 4111 1111 1111 1111 or 1a"
    row = pii.base_spans(documents(spark_llm, [text]), "text").first()
    seeds = {(o["start"], o["end"], o["value"]) for o in row["occurrences"] if o["kind"] is not None}
    assert seeds == {(start, end, text[start:end]) for start, _, end in brute(text)}
    assert [o["value"] for o in row["occurrences"] if o["kind"] is None] == ["12", "7\uf8fd7", "id5", "1a"]
