"""Cross-tokenizer alignment against whole texts encoded by the two libraries and counted in dictionaries."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tideline.llm import crosstoken

COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@pytest.fixture(scope="module")
def tokenizers():
    return crosstoken.default_tokenizers()


def plain(texts, tokenizers):
    """(counts and groups) of each text."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_str(tokenizers[0].decode()), sentencepiece.SentencePieceProcessor(model_proto=tokenizers[1])
    a.encode_special_tokens = True
    level = {bytes([i]): c for c, i in crosstoken.byte_symbols().items()}
    assert all(decoders.ByteLevel().decode([level[bytes([i])]]) == chr(i) for i in range(128))
    back = {c: i[0] for i, c in level.items()}

    def ends(tokens):
        at, out = 0, []
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    made, holds = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        ab = [bytes(back[c] for c in a.id_to_token(i)) for i in x]
        bb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        if not text or b"".join(ab) != want or b"".join(bb) != want:
            made.append(([], [], []))
            continue
        ea, eb = ends(ab), ends(bb)
        cuts = sorted(set(ea) & set(eb))
        group = {e: k for k, e in enumerate(cuts)}
        groups = [([], []) for _ in cuts]
        for side, (ids, ends_of) in enumerate(((x, ea), (y, eb))):
            k = 0
            for i, e in zip(ids, ends_of):
                groups[k][side].append(i)
                k = group[e] + 1 if e in group else k
        made.append((x, y, groups))
        holds.update({(i, j) for p, q in groups for i in p for j in q})
    best = defaultdict(int)
    for (i, _), n in holds.items():
        best[i] = max(best[i], n)
    out = []
    for x, y, groups in made:
        links = [(i, j) for p, q in groups for i in p for j in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(holds[k] == best[k[0]] for k in links), sum(holds[k] for k in links), text))
    return out


def check(df, tokenizers, **how):
    given = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = Counter((i, *x) for (i, _), x in zip(given, plain([t for _, t in given], tokenizers)))
    got = Counter((r.doc_id, *(r[c] for c in COUNTS), r.groups) for r in crosstoken.align(df, tokenizers, **how).collect())
    assert got == want
    return got


def test_whole_table(docs, tokenizers):
    got = check(docs, tokenizers)
    assert sum(k[4] for k in got) > 100_000


def test_join_instead_of_files(docs, tokenizers):
    check(docs.where("doc_id < 40"), tokenizers, mapped=False)


def test_messy(spark, messy, empty, tokenizers):
    check(messy, tokenizers)
    texts = ["a  b", "a\n  b \n c", " lead", "trail  ", "  ", "\n", " x   y", "　 　", "<|endoftext|> <s> </s> <unk> <0x0A>", "x▁y", "\x1c \x1d a", "it's we'LL 123 4,5", "漢字かな交じり文 🙂🙂 é́", "\x00 a", "z" * 5000, "ÿ" * 3000, "a\t b\r\n c", "\u0085 q"]
    check(spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, groups string, n_a int"), tokenizers)
    got = crosstoken.align(empty, tokenizers)
    assert got.count() == 0 and [c for c in got.columns if c not in (*COUNTS, "groups")] == [c for c in empty.columns if c != "text"]


def test_small_tables_in_tasks(spark, docs, tokenizers, monkeypatch):
    """Forgotten runs, partial counts given on early and many shards change nothing."""
    rows = docs.where("doc_id < 60")
    want = sorted(map(tuple, crosstoken.align(rows, tokenizers, groups="groups_sha256").collect()))
    monkeypatch.setattr(crosstoken, "SHARD_ROWS", 500)
    for name, value in (("MOST_KNOWN", 300), ("MOST_KEYS", 200)):
        monkeypatch.setattr(crosstoken, name, value)
    partial = crosstoken.materialise(crosstoken.partial_counts(crosstoken.linked(rows, tokenizers, "groups")))
    counts = crosstoken.counted(partial, 500)
    assert counts.rdd.getNumPartitions() > 8
    keys = [r.key for r in counts.collect()]
    assert len(keys) == len(set(keys)) and keys == sorted(keys)
    assert sorted(map(tuple, crosstoken.align(rows, tokenizers, groups="groups_sha256").collect())) == want


def test_digest(docs, tokenizers):
    rows = docs.where("doc_id < 5")
    text = {r.doc_id: r.groups for r in crosstoken.align(rows, tokenizers).collect()}
    for r in crosstoken.align(rows, tokenizers, groups="groups_sha256").collect():
        assert r.groups_sha256 == (hashlib.sha256(text[r.doc_id].encode()).hexdigest() if text[r.doc_id] else "")
    with pytest.raises(ValueError):
        crosstoken.align(rows, tokenizers, groups="other")
