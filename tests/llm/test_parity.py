"""Every row's ids are compared with those of the sentencepiece library."""

from tideline.llm import sentencepiece_bridge as bridge


def test_each_row_is_compared(spark, messy, docs):
    model = bridge.model_bytes(spark, bridge.default_model())
    for rows in (messy, docs):
        got = bridge.encode(rows.select("doc_id", "text"), model).toPandas()
        assert got[got.text.notna()].parity.eq(True).all() and got[got.text.isna()].parity.isna().all()


def test_mismatch_is_seen(spark):
    """By runs alone, one wrong id of a run shows in all texts that hold it, and in no other."""
    model = bridge.model_bytes(spark, bridge.default_model())
    ours = bridge.Backend(model)
    texts = ["the quick fox", " the  end", "quick", "", "ends with a space ", "a▁b"]
    ids, _, same = ours.encode(texts)
    assert ids.to_pylist() == bridge.original(model).encode(texts) and same == [True, True, True, True, None, None]
    ours.forget()
    plain = ours.theirs
    ours.theirs = lambda runs: [[0] if r == " quick" else i for r, i in zip(runs, plain(runs), strict=True)]
    assert ours.encode(texts)[2] == [False, True, False, True, None, None]


def unigram(pieces):
    """The bytes of a unigram model of pieces (text, score), without a normaliser's table."""
    import struct

    def field(number, data):
        return bytes([number << 3 | 2]) + varint(len(data)) + data

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, s, 1) for p, s in pieces)]
    made = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(kind)) for p, s, kind in rows)
    return made + field(2, b"\x18\x01") + field(3, field(1, b"identity") + b"\x20\x00")


def test_ties_are_broken_as_the_library_does(spark):
    """Whole table and runs of one sign, whose best pieces tie: ids are the library's on each row."""
    scores = [(bridge.MARKER, -2.1), ("#", -1.3), ("##", -2.6), ("###", -3.9), ("a", -3.3), ("b", -3.7), ("ab", -7.0), ("ba", -7.0), ("aba", -10.3)]
    model = unigram(scores)
    texts = ["#" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)] + ["a # ab ## aba b", "x##y", "", " ## ", "ba" * 7 + "#" * 5]
    got = bridge.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).toPandas()
    want = bridge.original(model).encode(texts)
    assert [list(x) for x in got.sort_values("doc_id").ids] == want
    assert (~got.parity.astype(bool)).any()  # else there was no tie to break
    assert [n for n in got.sort_values("doc_id").n_ids] == [len(x) for x in want]


def test_runs_are_cut_where_no_piece_joins(spark, monkeypatch):
    """Words beside signs and line feeds are learnt once, not once for each neighbour, and common ones stay when the
    table is full; ids are the library's on characters of all kinds."""
    model = bridge.model_bytes(spark, bridge.default_model())
    ours, library = bridge.Backend(model), bridge.original(model)
    words = [f"{a}{b}ing" for a in "abcdefgh" for b in "klmnopqr"]
    texts = ["".join(f" {a},\n{b}." for b in words)[1:] for a in words]
    ids, trip, same = ours.encode(texts)
    assert ids.to_pylist() == library.encode(texts) and all(trip) and all(same)
    assert len(ours.known) <= 2 * len(words) + 8
    odd = ["é\né \n 日本語\n\nさ", "\n", "\n\n a", " \n", "a\r\nb\tc\0d", "😀 😀\n😀", "x" * 300 + "\n" + "é" * 300, "0123\n45 6", "<0x0A>\n<s> </s><unk>", "  \n  b", "  　\n", "a \nb", "ẅ\n", "é\ń"]
    monkeypatch.setattr(bridge, "MOST_KNOWN", 800)
    learnt, learn = [], ours.learn
    ours.learn = lambda new: (learnt.append(set(new)), learn(new))
    for at in range(20):
        part = [*odd, *(f"{words[at]}{a}{b}" for a in words[:10] for b in words[10:20])]
        ids, trip, same = ours.encode(part)
        assert [x for x, s in zip(ids.to_pylist(), same, strict=True) if s is not None] == [x for x, s in zip(library.encode(part), same, strict=True) if s is not None]
        assert all(trip) and False not in same and len(ours.known) <= 800
    assert "語" in learnt[0] and not any("語" in x for x in learnt[1:])
