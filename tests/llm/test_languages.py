"""Language identification against a plain version, ties, and texts of many MB."""

import zstandard

from skein.llm import language_id


def plain(text, dictionaries):
    """(language, score, accepted) of one text, by the rules and zstandard alone."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, False
    letters = b" ".join("".join(c if "a" <= c <= "z" or ord(c) >= 0x80 else " " for c in text.lower()).encode().split())
    sizes = []
    for name in sorted(dictionaries):
        level = 9 if len(letters) < 2000 else 3
        held = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        sizes.append((len(zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress(letters)), name))
    (best, name), *rest = sorted(sizes)
    second = rest[0][0] if rest else 2 * best
    return name, min(1.0, (second - best) / second), (second - best) / second >= 0.001


DICTIONARIES = {
    "en": b"the house stands near the river and the people walk along the water every morning before work begins " * 40,
    "de": "das haus steht nahe am fluss und die menschen gehen jeden morgen vor der arbeit am wasser entlang über die brücke ".encode() * 40,
    "copy-a": b"lorem ipsum dolor sit amet consectetur " * 40,
    "copy-b": b"lorem ipsum dolor sit amet consectetur " * 40,
}


def test_equal_to_the_plain_version(spark):
    texts = [None, "", "1234 !?", "The people walk along the river.", "Die Menschen gehen über die Brücke.", "lorem ipsum dolor sit amet", "x", "é", "the das the das", "The House " * 400, "word " * 1_500_000]
    rows = spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["accepted"]) for r in language_id.predict(rows, DICTIONARIES).collect()}
    assert got == {i: plain(t, DICTIONARIES) for i, t in enumerate(texts)}
    # equal dictionaries tie: the name that sorts first wins, and the decision is rejected
    assert got[5] == ("copy-a", 0.0, False)
    assert got[3][0] == "en" and got[4][0] == "de" and got[3][2] and got[4][2]
