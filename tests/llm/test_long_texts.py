"""Fingerprints of very long texts."""

from quarry.llm import fingerprint


def test_likeness_of_long_texts(spark):
    """Texts of more phrases than 16 bits count."""
    words = lambda start, n: " ".join(f"w{i}." for i in range(start, start + n))
    texts = [words(0, 80_000), words(80_000, 80_000), words(120_000, 80_000), "yes. " * 150_000, "no. " * 150_000, words(0, 80_000) + " more."]
    got = [r.near_next for r in fingerprint.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] < 0.25  # nothing shared
    assert 0.15 < got[1] < 0.55  # half shared: 1/3
    assert got[2] < 0.25
    assert got[3] < 0.5  # one phrase each, repeated
    assert got[5] > 0.99  # one phrase more
