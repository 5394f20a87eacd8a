"""Pages in other character sets, encoded bodies, files of many members; long, null and tied pages."""

import gzip
import zlib

import pytest

from granary.llm import warc

TEXT = "Café Straße año"


def _headers(**said):
    return [{"name": k.replace("_", "-"), "value": v} for k, v in said.items()]


@pytest.mark.parametrize("name", ["utf-8", "iso-8859-1", "windows-1252", "utf-16"])
def test_character_sets(name):
    html = f"<p>{TEXT}"
    assert warc.page_text(_headers(Content_Type=f"text/html; charset={name}"), html.encode(name)) == html
    meta = f'<meta charset="{name}"><p>{TEXT}'
    if name != "utf-16":
        assert warc.page_text([], meta.encode(name)) == meta
    assert warc.page_text(_headers(Content_Type="text/html; charset=no-such"), html.encode()) == html


def test_encodings():
    body = f"<title>T</title><p>{TEXT}</p>".encode() * 50
    chunked = b"".join(b"%x;a=b\r\n%s\r\n" % (len(body[k : k + 100]), body[k : k + 100]) for k in range(0, len(body), 100)) + b"0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    cases = [
        (_headers(Transfer_Encoding="chunked"), chunked),
        (_headers(Content_Encoding="gzip"), gzip.compress(body)),
        (_headers(Content_Encoding="deflate"), zlib.compress(body)),
        (_headers(Content_Encoding="deflate"), raw.compress(body) + raw.flush()),
        (_headers(content_encoding="gzip"), body),
        (_headers(Transfer_Encoding="chunked"), body),
    ]
    for headers, payload in cases:
        assert warc.entity(headers, payload) == body
        metadata, conversion = warc.derive("<urn:uuid:1>", "u", "d", headers, payload)
        assert TEXT.encode() in conversion[-1] and metadata[8] == warc.digest(payload)


def test_files_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 64)
    record = {"warc_type": "response", "target_uri": "u", "warc_date": "d", "content_type": "application/http"}
    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"x" * n for n in (0, 1, 63, 64, 1000, 5000)]
    packed = b"".join(warc.serialise(record | {"record_id": f"<{k}>", "block": b}) for k, b in enumerate(blocks))
    for data in (packed, gzip.decompress(packed)):
        assert [(h["warc-record-id"], b) for h, b in warc.parse(data)] == [(f"<{k}>", b) for k, b in enumerate(blocks)]
    (tmp_path / "a.warc.gz").write_bytes(packed)
    assert sorted(len(r["payload"]) for r in warc.read_responses(spark, str(tmp_path)).collect()) == [0, 1, 63, 64, 1000, 5000]
    derived = warc.build_derivatives(warc.read_responses(spark, str(tmp_path))).first().asDict()
    assert b"WARC-Refers-To-Target-URI: u" in gzip.decompress(warc.serialise(derived)) and b"WARC-Refers-To-Date: d" in gzip.decompress(warc.serialise(derived))


def test_every_page_by_brute_force(spark):
    pages = [(k, f"http://h/{k}", f"<html><title>t {k}</title><body>" + "".join(f"<p>para {j} of {k}</p>" for j in range(k % 7)) + "</body>") for k in range(60)]
    pages += [(60, "http://h/60", "<p>" + "long text " * 200_000), (61, None, None), (None, "", ""), (5, "http://h/5", pages[5][2]), (5, "http://h/5", pages[5][2])]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.build_derivatives(warc.responses_from_pages(table), id_col="page_id").collect()
    assert len(got) == 2 * len(pages)
    texts = sorted(r["block"].decode() for r in got if r["warc_type"] == "conversion")
    want = []
    for k, _, html in pages:
        if k == 60:
            want.append(" ".join("long text".split() * 200_000))
        elif not html:
            want.append("")
        else:
            want.append("\n".join(f"para {j} of {k}" for j in range(k % 7)))
    assert texts == sorted(want)
    ids = [r["record_id"] for r in got]
    assert len(set(ids)) == 2 * (len(pages) - 2)
