import random

import zstandard
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.llm import warc


@given(st.lists(st.binary(min_size=1, max_size=300), min_size=1, max_size=6))
def test_seek_table(frames):
    content = warc.bundle(frames)
    assert [warc.frame(content, e) for e in warc.seek_table(content)] == frames
    # The footer is a skippable frame: any reader sees the frames' contents one after another.
    with zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True) as reader:
        assert reader.read() == b"".join(frames)


def pages(spark):
    rng = random.Random(2)
    html = ["", "<p>é</p>\r\n\r\nWARC/1.1", "y" * 300_000, "<a>"]
    rows = [(i, rng.choice([None, f"http://x/{i}\r\n"]), rng.choice([*html, None, f"<b>{i}</b>"])) for i in range(150)]
    return [*rows, (None, "u", "<a>"), (None, None, "only null"), (7, "again", "tie"), (7, "again", "tie")], spark


def brute(rows, least):
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h in rows:
        winner = best.get(h or "")
        revisit = winner is not None and winner != i and len((h or "").encode()) >= least
        raw = (h or "").encode()
        out.append((None if i is None else str(i), len(raw), warc.digest(raw), "revisit" if revisit else "response", str(winner) if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows, _ = pages(spark)
    frame = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    for least in (0, 4):
        bundles = warc.write_bundles(frame, min_bytes=least, frame_bytes=2000, bundle_bytes=20_000)
        read = warc.read_bundles(bundles).collect()
        got = [(None if r["id"] == "null" else r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in read]
        assert sorted(got, key=str) == brute(rows, least)
        assert all(r["intact"] for r in read)
        contents = {r["bundle"]: r["content"] for r in bundles.collect()}
        for r in warc.record_index(bundles).collect():
            head, _ = warc.read_record(contents[r["bundle"]], r["frame"], r["offset"])
            assert head["WARC-Record-ID"] == f"<urn:page:{r['record']}>"
    texts = {(i, h or "") for i, _, h in rows}
    assert all((None if r["id"] == "null" else int(r["id"]), r["payload"].decode()) in texts for r in read if r["record_type"] == "response")
    assert warc.save_files(bundles, str(tmp_path)) == len(contents)
    assert warc.read_files(spark, str(tmp_path)).count() == len(rows)
    assert warc.read_bundles(warc.write_bundles(frame.limit(0))).collect() == []
