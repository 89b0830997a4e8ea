import base64
import hashlib
import random
from collections import defaultdict

from chronoveil.llm import warc

KIND = "page_id bigint, url string, html string, sha string, value string, first int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", "v", 1) for r in rows], KIND)


def fixture():
    rng = random.Random(7)
    rows = [(i, f"http://www.Host{i % 5}.example.com:80/a/{i}?q=é#f", "".join(rng.choice("ab<é\r\n🙂") for _ in range(rng.randrange(60)))) for i in range(60)]
    rows += [(60 + i, "http://hot.example.org/", "<p>same</p>") for i in range(30)]
    return rows + [(200, None, None), (201, "", ""), (202, "mailto:x", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n\r\n\r\n"), (203, "http://x/\r\nA: b", "y")]


def brute(rows, least=0):
    first, out = {}, []
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        first.setdefault(html or "", i)
    for i, _, html in rows:
        raw = (html or "").encode()
        again = first[html or ""] != i and len(raw) >= least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None))
    return out


def test_archive_round_trip(spark, tmp_path):
    rows = fixture()
    for least in (0, 10):
        index = warc.archived_pages(pages(spark, rows), str(tmp_path / f"a{least}"), least=least, records_per_file=16)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index.collect()]
        assert sorted(got) == sorted(brute(rows, least))


def test_histories_are_in_global_order(spark, tmp_path):
    rows = fixture()
    warc.write_archive(pages(spark, rows).repartition(5), str(tmp_path / "b"), records_per_file=8)
    found = warc.capture_index(spark, str(tmp_path / "b"), range_rows=10).collect()
    order = [warc.order_of(tuple(r)) for r in found]
    assert order == sorted(order) and len(found) == len(rows)
    assert len({r.file for r in found}) > 5
    urls = defaultdict(list)
    for r in found:
        urls[r.url_key].append(r.captured)
    assert len(urls["org,example,hot)/"]) == 30 and all(v == sorted(v) for v in urls.values())


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in list(range(6)) + [17]:
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=1#c") == "com,example)/a?b=1"
    assert warc.url_key("https://user@m.a.org:8443") == "org,a,m:8443)/"
    assert warc.url_key(" Mailto:X ") == "mailto:x" and warc.url_key("") == ""


def test_nulls_repeated_rows_and_empty(spark, tmp_path):
    rows = [(None, "u", "p"), (1, "u", "p"), (1, "u", "p"), (2, "u", "p"), (None, "v", "only"), (None, "v", "only")]
    got = warc.archived_pages(pages(spark, rows), str(tmp_path / "c")).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == [(0, "response", 0), (0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "revisit", 1)]
    assert warc.archived_pages(pages(spark, []), str(tmp_path / "d")).collect() == []
