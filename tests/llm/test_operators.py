"""Every operator against a brute-force version, an exact round trip, or held-out accuracy."""

import collections
import hashlib
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from brandweave.llm import common, graph, html, jaccard, language_model, licenses, media, mixing, neighbours, packing, pii, quality


def documents(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, sources[i] if sources else "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def random_texts(n, seed, words=60, low=0, high=80):
    rng = random.Random(seed)
    return [" ".join(f"W{rng.randrange(words)}" for _ in range(rng.randrange(low, high))) for _ in range(n)]


def test_hash_words_agree_with_split():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"aB\xc3\xa9 \t\n\r\x0b\x0c\x00z") for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    texts.append(b"ab " * 1_500_000)
    hashes, counts = common.hash_words(texts)
    expected = [t.lower().split() for t in texts]
    assert counts.tolist() == [len(w) for w in expected]
    names: dict = {}
    for word, value in zip((w for ws in expected for w in ws), hashes.tolist()):
        assert names.setdefault(word, value) == value
    assert len(set(names.values())) == len(names)


# media


def test_media_round_trip_and_ranges(spark):
    texts = ["", "a" * 575, "b" * 576, "c" * 577, "é" * 1000, *random_texts(300, 2)]
    docs = documents(spark, texts).repartition(3)
    folder = common.fresh_path(spark, "media-test")
    media.write_archives(docs, f"{folder}/archives", archive_bytes=20_000).write.parquet(f"{folder}/manifest")
    members = media.read_archives(spark, f"{folder}/manifest", splitBytes=3000)
    assert members.select("archive", "offset").distinct().count() == members.count() == len(texts)
    assert members.rdd.getNumPartitions() > 5
    for r in media.features(members).collect():
        payload = texts[r.doc_id].encode()
        payload += b"\xff" * (-len(payload) % 576 if payload else 576)
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_retries_members(spark, monkeypatch):
    docs = documents(spark, ["x", "y"]).coalesce(1)
    folder = common.fresh_path(spark, "media-test")
    media.write_archives(docs, f"{folder}/archives").write.parquet(f"{folder}/manifest")
    reader = media.ArchiveReader({"path": f"{folder}/manifest", "pause": "0"})
    real, failed = media._member, []

    handles = []

    def flaky(file, info):
        handles.append(file)
        if info.filename not in failed:
            failed.append(info.filename)
            raise (OSError, media.struct.error)[len(failed) % 2]("lost")
        return real(file, info)

    monkeypatch.setattr(media, "_member", flaky)
    parts = reader.partitions()
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 2 and len(failed) == 2
    assert len(handles) == 4 and handles[1] is handles[2] and handles[0] is not handles[1] and handles[2] is not handles[3]
    monkeypatch.setattr(media, "_member", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        [b for p in parts for b in reader.read(p)]


# personal data


def test_permute_is_a_permutation_with_an_inverse():
    for n in (1, 2, 3, 10, 97, 1000):
        image = [pii.permute(i, n, b"k", "x") for i in range(n)]
        assert sorted(image) == list(range(n))
        assert [pii.permute(i, n, b"k", "x", undo=True) for i in image] == list(range(n))


def test_permute_is_a_permutation_of_every_class():
    for n, side in ((1000, lambda v: v % 3 == 0), (97, lambda v: v > 90), (10, lambda v: v == 4), (500, lambda v: v // 100)):
        image = [pii.permute(i, n, b"k", "x", side) for i in range(n)]
        assert sorted(image) == list(range(n)) and all(side(a) == side(b) for a, b in enumerate(image))
        assert [pii.permute(i, n, b"k", "x", side, undo=True) for i in image] == list(range(n))


def test_different_values_have_different_pseudonyms():
    rng = random.Random(19)
    sets = [
        {".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(3000)} | {"213.244.179.178", "228.111.203.126", "10.0.0.1", "127.0.0.1"},
        {f"{rng.randrange(1000):03d}-{rng.randrange(1000):03d}-{rng.randrange(10000):04d}" for _ in range(3000)} | {"618-484-3312", "116-912-4599"},
        {f"{d:02d}/{m:02d}/{y}" for y in range(1983, 1988) for m in range(1, 13) for d in range(1, 29)} | {f"{m:02d}/{d:02d}/{y}" for y in range(1983, 1988) for m in range(1, 13) for d in range(1, 29)},
        {f"{d:02d}.{m:02d}.{y:02d}" for y in range(100) for m in (1, 2, 12) for d in range(1, 29)},
        {f"{y:02d}-{m:02d}-{d:02d}" for y in range(100) for m in (1, 2, 12) for d in range(1, 29)},
        {f"0{rng.randrange(1, 1000)} {rng.randrange(10**6, 10**7)}" for _ in range(2000)},
        {f"password: {''.join(rng.choice('abcdef0123ghi') for _ in range(8))}" for _ in range(3000)},
    ]
    for values in sets:
        out = {v: pii.replace(v) for v in values}
        assert len({new for new, _ in out.values()}) == len(values)
        for v, (new, found) in out.items():
            assert [k for k, _, _ in found] == [k for k, _, _ in pii.replace(new)[1]], (v, new)
    assert sum(v in {n for n, _ in out.values()} for v in values) < 5


def test_phone_numbers_without_a_plus():
    for text in ("0171 2345678", "030/12345678", "01 23 45 67 89", "020 7946 0958", "0711-123456"):
        out, found = pii.replace(f"Ruf {text} an")
        assert found == [("phone", 4, len(text))] and text not in out and out[4] == "0", text
    for text in ("Call 6184843312 now", "phone: 6184843312", "Tel. 6184843312", "fax number is 6184843312"):
        out, found = pii.replace(text)
        assert [k for k, _, _ in found] == ["called"] and "6184843312" not in out
        assert re.search(r"\d{10}", out)[0] == pii.replace("618-484-3312")[0].replace("-", "")
    for clean in ("order 6184843312 shipped", "0 2345678", "room 012 34", "01/02 34", "call 1184843312"):
        assert pii.replace(clean) == (clean, [])


def test_personal_values_of_given_documents(spark, sf_dir):
    """Emails, card numbers, addresses and long dates by other means than the operator's pattern."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    seen = collections.Counter()
    for text in texts:
        out, found = pii.replace(text)
        spans = [(a, a + n) for _, a, n in found]
        for m in re.finditer(r"\S+", text):
            word = m[0].strip(".,;:()[]\"'<>!?")
            at = m.start() + m[0].index(word) if word else 0
            parts = word.split(".")
            kind = None
            if word.count("@") == 1 and all(p.replace("-", "").isalnum() and p.isascii() for p in word.split("@")[1].split(".")) and "." in word.split("@")[1] and re.fullmatch(r"[a-z0-9.]+", word.split("@")[0]):
                kind = "email"
            elif len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) < 256 and len(p) < 4 for p in parts):
                kind = "ipv4"
            elif len(word) == 16 and word.isascii() and word.isdigit() and pii.luhn_digit(word[:-1]) == word[-1]:
                kind = "card"
            if kind:
                seen[kind] += 1
                assert any(a <= at and at + len(word) <= b for a, b in spans), (kind, word)
                assert word not in out
    assert seen["email"] > 0


def test_pseudonyms_keep_formats_and_links():
    text = 'Mail jo.99@mail0.example.com or +1 (605) 555-9305, card 4078918989542222 = 4078-9189-8954-2222, 37.92.178.161, 1980-02-29, 123-45-6789, DE89 3704 0044 0532 0130 00, api_key = "9f86d081884c7d65".'
    out, found = pii.replace(text)
    assert [k for k, _, _ in found] == ["email", "phone", "card", "card", "ipv4", "date", "ssn", "iban", "secret"]
    assert [text[a : a + n] for _, a, n in found][0] == "jo.99@mail0.example.com"
    for value in ("jo.99", "605) 555-9305", "4078918989542222", "37.92.178.161", "1980-02-29", "123-45-6789", "3704 0044", "9f86d081884c7d65"):
        assert value not in out
    again, found_again = pii.replace(out)
    assert [k for k, _, _ in found_again] == [k for k, _, _ in found]
    cards = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}", out)
    assert len(cards) == 2 and cards[0] == cards[1].replace("-", "") and pii.luhn_digit(cards[0][:-1]) == cards[0][-1]
    assert pii.replace(text, b"other")[0] != out
    clean = "Licensed under CC BY-NC 4.0, version 2.0, in 12345 copies; see a::b and 4078918989542223."
    assert pii.replace(clean) == (clean, [])


def test_ibans_before_other_words_and_values_inside_failed_matches():
    for text, iban in (
        ("Pay ES9121000418450200051332 OK", "ES9121000418450200051332"),
        ("BE68 5390 0754 7034 2024", "BE68 5390 0754 7034"),
        ("AT61 1904 3002 3457 3201 IBAN A1", "AT61 1904 3002 3457 3201"),
        ("AB13 BE68 5390 0754 7034 XY", "BE68 5390 0754 7034"),
        ("DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
    ):
        out, found = pii.replace(text)
        assert found == [("iban", text.index(iban), len(iban))]
        assert out[: text.index(iban)] == text[: text.index(iban)] and out[text.index(iban) + len(iban) :] == text[text.index(iban) + len(iban) :]
        assert iban not in out and pii.replace(out)[1] == found
    assert [k for k, _, _ in pii.replace("AB12 4078 9189 8954 2222")[1]] == ["card"]


def test_dates_with_short_years_times_and_month_names():
    for text in ("05/03/84", "25/12/84", "5.3.84", "84-05-03", "03-May-84", "3 May 1984", "May 3rd, 1984", "Sept. 3, 1984", "MAY 3, 1984", "3. M\u00e4rz 1984", "1er mai 1984", "3 de mayo de 1984", "1984-May-03", "1984-05-03"):
        out, found = pii.replace(f"born {text}, here")
        assert found == [("date", 5, len(text))] and text not in out, text
        again = pii.replace(out)[1]
        assert len(again) == 1 and again[0][0] == "date" and again[0][2] == len(out) - 11, out
    for text in ("1984-05-03T10:00", "1984-05-03T10:00:00Z", "1984-05-03 10:00"):
        out, found = pii.replace(text)
        assert found == [("date", 0, 10)] and out[10:] == text[10:] and out[:10] == pii.replace("1984-05-03")[0]
    year, month, day = pii.replace("1984-05-03")[0].split("-")
    months = pii.MONTHS["en"][0].split()
    assert pii.replace("May 3, 1984")[0] == f"{months[int(month) - 1]} {int(day)}, {year}"
    days = [f"{d:02d}/{m:02d}/84" for m in range(1, 13) for d in range(1, 29)]
    assert len({pii.replace(d)[0] for d in days}) == len(days)
    for clean in ("version 1.2.3", "version 3.10.12", "May 3, 20 people", "in May 1984", "31/31/84", "2024-05-03TX"):
        assert pii.replace(clean) == (clean, [])


# main text


def test_main_text_of_an_awkward_page():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>"
        "<div id='cookie-notice'>We use cookies and you must accept all of them now, dear reader.</div><div class=wrap><div class='post'><h2>A &amp; B</h2>"
        "<p>First <b>par</b>agraph, long enough to count among the other lines of this page.<br>Next<p>Short.<ul><li>one<li>two</ul><form><input><label>Mail</label></form>"
        "<script>var a='<p>no</p>';</script><p>Last   paragraph\nwith much text to be found by smoothing of the ratios.</p></div><aside>Related, and long enough to be taken for text.</aside>"
        "<div class='comments'><p>I do not agree with this article at all and say so at length.</p></div></div><footer>c</footer></body></html>"
    )
    assert html.main_text(page) == "A & B\nFirst paragraph, long enough to count among the other lines of this page. Next\nShort.\none\ntwo\nLast paragraph with much text to be found by smoothing of the ratios."


def test_main_text_after_what_only_looks_like_a_comment():
    body = "<p>First paragraph, long enough to count among the lines of this page.</p>{}<p>Second paragraph, with as much text as the first one had.</p>"
    first, second = "First paragraph, long enough to count among the lines of this page.", "Second paragraph, with as much text as the first one had."
    for head in ("<script><!-- var a; </script>", "<style><!-- p{}</style>", "<title>a <!-- b</title>"):
        assert html.main_text(f"<html><head>{head}</head><body>{body.format('')}").splitlines() == [first, second]
    for middle in ("<script>if(a<!--b)c()</script>", "<script>s='<!--'</script>", "<img alt='<!-- x'>", "<!-- x --!>", "<!-->", "<!--->", "<noscript><!-- a</noscript>"):
        assert html.main_text(body.format(middle)).splitlines() == [first, second]
    assert html.main_text(body.format("<!-- never closed > <b>")) == first
    assert html.main_text(body.format("<!-- a -- > b --- c > <b> --><!-- x")) == first


def test_main_text_in_marked_wrappers():
    texts = [f"Paragraph {i} of the article, long enough to count <b>among</b> the lines of this page." for i in range(4)]
    paragraphs = "".join(f"<p>{t}</p>" for t in texts)
    article = "\n".join(re.sub("</?b>", "", t) for t in texts)
    menu, note = "<nav><a href=x>Menu</a></nav>", "<div class='cookie-notice'>We use cookies and you must accept all of them.</div>"
    foot = "<div class='comments'><p>I do not agree with this article at all.</p></div><footer>All about us and what we do.</footer>"
    for start, end in (
        ("<form id=f action=/>", "</form>"),
        ("<form><fieldset>", "</fieldset></form>"),
        ("<div class='elementor-widget'><div class='elementor-widget-container'>", "</div></div>"),
        ("<div class='side-by-side'>", "</div>"),
        ("<div id='search-result'>", "</div>"),
        ("<div class='legal-text'>", "</div>"),
    ):
        assert html.main_text(f"<html><body>{start}{menu}{note}<div>{paragraphs}</div>{foot}{end}</body></html>") == article
        assert html.main_text(f"<html><body>{menu}{note}{start}{paragraphs}{end}{foot}</body></html>") == article
    widgets = "".join(f"<div class='elementor-widget-container'><p>{t}</p></div>" for t in texts)
    assert html.main_text(f"<body>{menu}<main>{widgets}</main>{foot}</body>") == article
    talk = "<div class='comments'>" + "<p>I do not agree with this article at all and say so at length.</p>" * 12 + "</div>"
    legal = "<div class='legal'>" + "<p>No part of this page may be copied in any form or by any means.</p>" * 9 + "</div>"
    assert html.main_text(f"<body>{menu}<div>{paragraphs}</div>{talk}</body>") == article
    assert html.main_text(f"<body>{menu}<article>{paragraphs}</article>{legal}</body>") == article
    assert html.main_text(f"<body>{menu}<div>{paragraphs}</div><form>Mail <label>Your address</label></form></body>") == article


def plain_page():
    """A page without telling names, and its article: menus and notes are short texts among many tags."""
    menu = "".join(f"<div><span>Part</span> <i>{i}</i></div>" for i in range(9))
    paragraphs = [f"Paragraph {i} of the article, with as many words as are needed for it to count among the others." * (1 + i % 3) for i in range(8)]
    paragraphs[3] = "Short."
    note = "".join(f"<div><span>Note {i}</span> <i>of</i> <u>all</u></div>" for i in range(9))
    stray = "<div>One long line that stands alone among the short ones, as slogans and the like do on many a page of the web.</div>"
    return f"<html><body><div>{menu}{stray}{menu}</div><div>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>{note}</div></body></html>", "\n".join(paragraphs)


def test_ratios_decide_the_region(monkeypatch):
    page, article = plain_page()
    assert html.main_text(page) == article
    real, smooth = html.ratios, html.smoothed
    for other in (lambda lines: np.ones(len(lines)), lambda lines: real(lines).max() - real(lines)):
        monkeypatch.setattr(html, "ratios", other)
        assert html.main_text(page) != article
    rng = np.random.default_rng(18)
    monkeypatch.setattr(html, "ratios", lambda lines: rng.random(len(lines)) ** 4)
    assert sum(html.main_text(page) != article for _ in range(20)) >= 15
    monkeypatch.setattr(html, "ratios", real)
    # without smoothing short lines part clusters and lone long ones make them
    lines = [10.0, 10.0, 90.0, 10.0, 10.0, 10.0, 10.0, 10.0, 80.0, 90.0, 10.0, 90.0, 80.0]
    raw, soft = html.clustered(np.array(lines)), html.clustered(smooth(np.array(lines), 2))
    assert raw.tolist() != soft.tolist() and soft[8:].all() and not raw[10]


def test_ratios_smoothing_and_threshold_by_hand(spark, sf_dir):
    """Recomputed from their definitions, line by line, for flat pages of plain paragraphs and links."""
    rng = random.Random(33)
    for _ in range(40):
        lines, page = [], ""
        for _ in range(rng.randint(1, 25)):
            text, link = "t" * rng.randint(1, 80), "l" * rng.randint(0, 20)
            bold = rng.randint(0, 3)
            page += f"<p>{'<b>' * bold}{text}{'</b>' * bold}" + (f"<a>{link}</a>" if link else "") + "</p>"
            lines.append((len(text), 2 + 2 * bold + (2 if link else 0)))
        parser = html._Lines()
        parser.feed(page)
        parser.close()
        found = parser.done()
        ratios = [n / tags for n, tags in lines]
        assert html.ratios(found).tolist() == pytest.approx(ratios)
        smooth = []
        for i in range(len(ratios)):
            weights = {j: math.exp(-((i - j) ** 2) / 8) for j in range(max(0, i - 4), min(len(ratios), i + 5))}
            smooth.append(sum(ratios[j] * w for j, w in weights.items()) / sum(weights.values()))
        assert html.smoothed(html.ratios(found)).tolist() == pytest.approx(smooth)
        mean = sum(smooth) / len(smooth)
        deviation = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
        near = [abs(x - min(deviation, max(smooth) / 2)) < 1e-9 for x in smooth]
        want = [x >= min(deviation, max(smooth) / 2) for x in smooth]
        assert [a or b == c for a, b, c in zip(near, html.clustered(np.array(smooth)).tolist(), want, strict=True)] == [True] * len(smooth)


def test_discussions_without_the_usual_names():
    article = "".join(f"<p>Paragraph {i} of the article, long enough to count among the lines.</p>" for i in range(3))
    talk = "".join(f"<p>I do not agree with part {i} of this article at all and say so at length.</p>" for i in range(6))
    for name in ("thread", "discussion-list", "reactions"):
        assert html.main_text(f"<body><div>{article}</div><div class='{name}'>{talk}</div></body>") == "\n".join(f"Paragraph {i} of the article, long enough to count among the lines." for i in range(3))


def test_main_text_without_article_elements(spark, sf_dir):
    rows = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    plain = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in rows]
    assert [html.main_text(h) for h in plain] == [html.main_text(h) for h in rows]
    bare = [re.sub(r"<(/?)(?:nav|footer)>", r"<\1div>", h).replace('class="ad"', "") for h in plain]
    assert sum(html.main_text(a) == html.main_text(b) for a, b in zip(bare, rows)) >= 0.8 * len(rows)


def test_names_mark_as_a_whole():
    texts = [f"Paragraph {i} of the article, long enough to count among the lines of this page." for i in range(6)]
    for name in ("share-prices", "side-effects", "search-engines", "legal-news", "legal-article", "notice-of-intent"):
        inner = "".join(f"<p class='{name}'>{t}</p>" if i in (2, 3) else f"<p>{t}</p>" for i, t in enumerate(texts))
        assert html.main_text(f"<body><div>{inner}</div><div class='site-footer'>All about us and what we do here.</div></body>") == "\n".join(texts)
        assert html.main_text(f"<body><div class='{name}'>{inner}</div></body>") == "\n".join(texts)
    for name in ("cookie-notice", "siteFooter", "post_comments", "related-posts", "ad-slot-2", "newsletterSignup"):
        inner = "".join(f"<p>{t}</p>" for t in texts)
        assert html.main_text(f"<body><div>{inner}<div class='{name}'>All about us and what we do here.</div></div></body>") == "\n".join(texts)


def test_main_text_takes_time_in_step_with_length():
    import time

    def seconds(n):
        start = time.process_time()
        for page in ("<div>" * n + "x", "<p><table><tr><td>" + "<div><b>x" * n, "<article>x" * n, "<ul>" + "<li><div class=ad>x" * n, "<div class=comments>x</b>" * n):
            html.main_text(page)
        return time.process_time() - start

    seconds(1000)
    assert seconds(16_000) < 16 * max(0.1, seconds(4000))


def test_main_text_of_given_pages(spark, sf_dir):
    from html import unescape

    for r in html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.split(r"</article>", r.html[r.html.index("<article>") + 9 :])[0]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", b)))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# quality


def test_kth_largest_with_ties(spark):
    values = [random.Random(3).choice([0.0, 1.5, -2.25, 1e9, 1e-9, 3.0]) * k for k in range(500)] + [1.0] * 300
    keys = common.stored(spark.createDataFrame([(v,) for v in values], "key double"), "keys")
    for k in (1, 2, 250, 799, 800):
        assert quality.kth_largest(keys, k, buckets=7, few=20) == sorted(values, reverse=True)[k - 1]


def brute_log_weights(spark, texts, labels, buckets=quality.BUCKETS):
    """Each text's log weight, from counts over buckets of single runs and pairs hashed one by one."""
    parts = spark.range(len(texts)).select(F.col("id"), (F.pmod(F.xxhash64("id", F.lit(quality.SEED)), F.lit(3)) == 0).alias("tuning"))
    tuning = {r.id: r.tuning for r in parts.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality and not tuning[r.doc_id]}
    of, runs = {}, []
    for text in texts:
        tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^\s0-9A-Za-z\x80-\U0010ffff]+", text)
        for run in [(t,) for t in tokens] + list(zip(tokens, tokens[1:])):
            if run not in of:
                own = quality.hashed_runs([" ".join(run).encode() if len(run) == 1 or run[0][0].isalnum() == run[1][0].isalnum() else "".join(run).encode()], buckets)[0]
                of[run] = int(own[-1])
        runs.append([of[t,] for t in tokens] + [of[p] for p in zip(tokens, tokens[1:])])
    raw, target = collections.Counter(), collections.Counter()
    for i, own in enumerate(runs):
        raw.update(own)
        if i in good:
            target.update(own)
    n, m = sum(raw.values()), sum(target.values())

    def ratio(b):
        share = (raw[b] + 1) / (n + buckets)
        return math.log((target[b] + buckets * share) / (m + buckets)) - math.log(share)

    return [sum(ratio(b) for b in own) for own in runs]


def test_quality_parts_shouting_from_prose(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.choice("the of river stone light walks under green".split()) for _ in range(80)) + "." for _ in range(300)]
    junk = [" ".join(f"{rng.choice('THE OF RIVER STONE'.split())}!!" for _ in range(80)) for _ in range(100)]
    docs = documents(spark, prose + junk)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 400, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep(docs, labels).collect()}
    held_out = range(1, 400, 2)
    assert sum((i in kept) == (i < 300) for i in held_out) >= 0.97 * len(held_out)
    expected = brute_log_weights(spark, prose + junk, labels)
    found = {r.doc_id: r.log_weight for r in quality.select(docs, quality.fit(docs, labels)).collect()}
    assert all(math.isclose(found[i], w, rel_tol=1e-9, abs_tol=1e-9) for i, w in enumerate(expected))
    chosen = quality.select(docs, quality.fit(docs, labels), k=50)
    assert chosen.where("kept").count() == 50
    assert chosen.where("kept").agg(F.min("key")).first()[0] >= chosen.where("not kept").agg(F.max("key")).first()[0]


# neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 17)).astype(np.float32) * rng.uniform(0.2, 3, size=(1500, 1)).astype(np.float32)
    x[100:400] = x[100]
    x[500:700] = x[500] + rng.normal(scale=0.002, size=(200, 17)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index, books = neighbours.build(vectors, sample_rows=500)
    found = collections.defaultdict(list)
    for r in neighbours.search(index, books, neighbours.usable(vectors).where("vec_id % 20 = 0"), block_rows=400, group_queries=30).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 1500, 20):
        scores = np.einsum("nd,d->n", x.astype(np.float64), x[q].astype(np.float64))
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        hits, total = hits + len({i for i, _ in found[q]} & set(order)), total + 20
        assert all(math.isclose(s, scores[i], rel_tol=1e-12) for i, s in found[q]) and len(found[q]) == 20
    assert hits >= 0.95 * total


# mixing


def brute_targets(sizes, weights, cap=3):
    left, target, total = set(sizes), {}, float(sum(sizes.values()))
    while left:
        share = {s: total * weights[s] / sum(weights[x] for x in left) for s in left}
        above = [s for s in left if share[s] > cap * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = cap * sizes[s]
            total -= target[s]
            left.discard(s)
    return target


def test_mixing_targets_and_reruns(spark):
    texts = random_texts(400, 6, low=1, high=200)
    rng = random.Random(7)
    sources = [None if rng.random() < 0.1 else rng.choice(["b", "a", "é", "Z"] + ["hot"] * 6) for _ in texts]
    docs = documents(spark, texts, sources)
    rows = mixing.plan(docs).collect()
    sizes = collections.Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(t.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    expected = brute_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    taken, largest = collections.Counter(), collections.defaultdict(int)
    for r in rows:
        assert math.isclose(r.target, expected[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size <= 3 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
    for s in sizes:
        mean = sizes[s] / sources.count(s)
        assert abs(taken[s] - expected[s]) <= mean
    again = mixing.plan(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_schedule_is_followed(spark):
    texts = ["word " * 50] * 300
    docs = documents(spark, [f"{t}{i}" for i, t in enumerate(texts)], ["a"] * 300)
    rows = mixing.plan(docs, weight=F.lit(1), schedule=F.array(F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("w")), F.struct(F.lit(0.5).alias("t"), F.lit(1.0).alias("w")), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("w")))).collect()
    positions = np.array([p for r in rows for p in r.positions])
    expected = lambda t: np.where(t < 0.5, 2 * t**2, 1 - 2 * (1 - t) ** 2)
    for t in (0.1, 0.25, 0.5, 0.75, 0.9):
        assert abs((positions < t).mean() - expected(t)) < 0.02
    order = [r.position for r in mixing.mix(docs).collect()]
    assert order == sorted(order)


# language model


def own_discounts(counts):
    """Chen and Goodman's estimates, D_k = k - (k + 1) Y n_(k+1) / n_k with Y = n_1 / (n_1 + 2 n_2), kept from
    0.05 to k; 0.5, 1 and 1.5 where a number of the first three is 0."""
    n = collections.Counter(counts)
    if not (n[1] and n[2] and n[3]):
        return [0.5, 1.0, 1.5]
    y = Fraction(n[1], n[1] + 2 * n[2])
    return [float(min(max(k - (k + 1) * y * Fraction(n[k + 1], n[k]), Fraction(1, 20)), k)) for k in (1, 2, 3)]


def test_discounts_by_hand():
    # 8 counts of 1, 4 of 2, 2 of 3 and 1 of 4: Y is a half
    assert language_model.discounts(8, 4, 2, 1) == (0.5, 1.25, 2.0)
    assert own_discounts([1] * 8 + [2] * 4 + [3] * 2 + [4]) == [0.5, 1.25, 2.0]
    assert language_model.discounts(8, 0, 2, 1) == (0.5, 1.0, 1.5)
    assert language_model.discounts(1, 100, 1, 0) == pytest.approx(own_discounts([1] + [2] * 100 + [3]))


def brute_model(texts):
    sentences = [["<s>", *t.lower().split(), "</s>"] for t in texts]
    pairs, single = collections.Counter(), collections.Counter()
    for s in sentences:
        single.update(s[1:])
        pairs.update(zip(s, s[1:]))
    after, before = collections.defaultdict(list), collections.Counter()
    for (u, w), c in pairs.items():
        after[u].append(c)
        before[w] += 1
    d, e = own_discounts(pairs.values()), own_discounts(before.values())
    less = lambda c, d: 0 if not c else d[min(c, 3) - 1]
    total = sum(before.values())
    rest = sum(less(c, e) for c in before.values()) / total

    def p(w, u):
        low = max(before[w] - less(before[w], e), 0) / total + rest / (len(single) + 1)
        if not after.get(u):
            return low
        return (max(pairs[u, w] - less(pairs[u, w], d), 0) + sum(less(c, d) for c in after[u]) * low) / sum(after[u])

    return p, single


def test_language_model_against_brute_force(spark):
    texts = random_texts(200, 8, words=40) + ["Hot word " * 400] * 3
    held = ["w1 w2 unseen w3", "", "w5 " * 30, "HOT word hot"]
    model = language_model.train(documents(spark, texts))
    p, single = brute_model(texts)
    vocabulary = [*single, "unseen"]
    for u in ("w1", "hot", "<s>", "never"):
        assert math.isclose(sum(p(w, u) for w in vocabulary), 1, rel_tol=1e-9)
    n, v = sum(single.values()), len(single)
    for r in language_model.score(documents(spark, held + texts[:20]), model).collect():
        words = (held + texts[:20])[r.doc_id].lower().split() + ["</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(single[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(w, u)) for u, w in zip(["<s>", *words], words)), rel_tol=1e-9)


def test_language_model_with_several_lists_of_files(spark, monkeypatch):
    texts = random_texts(120, 21, words=60)
    whole = {r.doc_id: r.score for r in language_model.score(documents(spark, texts), language_model.train(documents(spark, texts))).collect()}
    monkeypatch.setattr(language_model, "SHARD_BYTES", 500)
    monkeypatch.setattr(language_model, "LISTED", 3)
    model = language_model.train(documents(spark, texts))
    arrays = language_model.Mapped(model)
    assert len(arrays.array(f"{model.words}.first", np.dtype("<u8"))) > 2
    parts = {r.doc_id: r.score for r in language_model.score(documents(spark, texts), model).collect()}
    assert parts == pytest.approx(whole)


def test_language_model_splits_hot_contexts(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 300)
    rng = random.Random(9)
    texts = [" ".join(f"the n{rng.randrange(700)}" for _ in range(40)) for _ in range(100)]
    model = language_model.train(documents(spark, texts))
    assert len(model.seats.hot) and model.seats.splits.max() > 1
    p, _ = brute_model(texts)
    for r in language_model.score(documents(spark, texts[:10]), model).collect():
        words = texts[r.doc_id].split() + ["</s>"]
        assert math.isclose(r.score, sum(math.log10(p(w, u)) for u, w in zip(["<s>", *words], words)), rel_tol=1e-9)


# packing


def test_token_ids_are_those_of_tokenizers(spark, sf_dir):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    known = Tokenizer.from_file(path)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a  b", "a \n b\n\n c  ", "é  ñ'll don't 12 3", "a b 　 c <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext|", " <|endoftext|>  x", "\n", " lead", "trail ", "x's  'tis", "😀 😀😀  z", "tab\t a\t\tb \t c"]
    encoder = packing.Encoder(path)
    assert np.frombuffer(encoder.ids("a b <|endoftext|> x"), dtype="<u4").tolist() == [64, 275, 220, 50256, 2124]
    for t in texts:
        assert encoder.ids(t) == np.array(known.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_pieces_and_sequences(spark):
    texts = random_texts(300, 10, low=0, high=2500)
    rows = packing.pack_documents(documents(spark, texts), group_pieces=150).collect()
    encoder = packing.Encoder(packing.default_tokenizer())
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = encoder.ids(t) + (2).to_bytes(4, "little")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and all(r.length == 1024 for r in pieces[1:])
        assert b"".join(ids[4 * r.start : 4 * (r.start + r.length)] for r in pieces) == ids
        assert all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in pieces)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r.length for r in rows) // 1024)
    assert len(by_sequence) <= least * 1.05 + 3


def test_sequences_follow_the_order_of_stored_rows(spark):
    texts = random_texts(600, 16, low=0, high=300)
    # Ids in no order, so that only files and rows tell the order; the same document comes twice.
    order = random.Random(17).sample(range(600), 600) * 2
    rows = spark.createDataFrame([(k, i, texts[i]) for k, i in enumerate(order)], "k long, doc_id long, text string")
    stored = common.stored(rows.repartitionByRange(3, "k").sortWithinPartitions("k").drop("k"), "mix")
    packed = packing.pack_documents(stored, ordered=True, group_pieces=100).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(order)
    groups = collections.defaultdict(list)
    for r in packed:
        if r.piece == 0:
            groups[r.sequence_id >> 32].append(r.doc_id)
    at = 0
    for g in sorted(groups):
        assert collections.Counter(groups[g]) == collections.Counter(order[at : at + len(groups[g])])
        at += len(groups[g])
    assert len(groups) > 10 and max(map(len, groups.values())) < 200


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_best_fit_meets_every_constraint(rule):
    lengths = np.sort(np.random.default_rng(11).integers(1, 101, 800))[::-1]
    bins, places = packing.best_fit(lengths, 100, 4, 6000, (1.0, 0.5, 0.5), rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 6000 or len(own) == 1


def naive_best_fit(lengths, max_tokens, max_documents, max_cost, weights, rule):
    """The tokens of the bins in the order of their opening, by scoring every open bin for each piece."""
    caps = (max_tokens, max_documents, max_cost)
    w = [x / c**2 for x, c in zip(weights, caps)]
    bins = []
    for number, size in enumerate(lengths):
        need = (size, 1, size * size)
        best = None
        for b in bins:
            left = b["left"]
            if all(x >= y for x, y in zip(left, need)) and all(left):
                score = -sum(a * x * y for a, x, y in zip(w, left, need)) if rule == "dot" else sum(a * (x - y) ** 2 for a, x, y in zip(w, left, need))
                key = (score, *left, -b["used"])
                if best is None or key < best[0]:
                    best = (key, b)
        if best is None:
            bins.append({"left": caps, "own": [], "used": 0})
        b = best[1] if best else bins[-1]
        b["left"] = tuple(x - y for x, y in zip(b["left"], need))
        b["own"].append(size)
        b["used"] = number
    return [b["own"] for b in bins]


@pytest.mark.parametrize("rule", ["residual", "dot"])
@pytest.mark.parametrize("limits", [(100, 100, 10_000, (1.0, 1e-5, 1e-5)), (100, 4, 6000, (1.0, 0.5, 0.5)), (64, 3, 64**2, (1.0, 0.0, 0.0)), (50, 50, 1500, (0.2, 1.0, 2.0))])
def test_best_fit_is_the_best_of_all_bins(rule, limits):
    tokens, documents, cost, weights = limits
    rng = np.random.default_rng(20)
    for _ in range(10):
        lengths = np.sort(rng.integers(1, int(min(tokens, cost**0.5)) + 1, 120))[::-1]
        bins, places = packing.best_fit(lengths, tokens, documents, cost, weights, rule)
        own = [lengths[bins == b].tolist() for b in range(bins.max() + 1)]
        assert own == naive_best_fit(lengths.tolist(), tokens, documents, cost, weights, rule)
        assert all(sorted(places[bins == b].tolist()) == np.concatenate([[0], np.cumsum(o)[:-1]]).astype(int).tolist() for b, o in enumerate(own))


def fewest_bins(lengths, capacity):
    """The least number of bins, over all subsets."""
    n = len(lengths)
    least = [(n + 1, 0)] * (1 << n)
    least[0] = (0, capacity)  # bins, and tokens in the last one
    for s in range(1, 1 << n):
        for i in range(n):
            if s >> i & 1:
                bins, used = least[s ^ 1 << i]
                own = (bins, used + lengths[i]) if used + lengths[i] <= capacity else (bins + 1, lengths[i])
                least[s] = min(least[s], own)
    return least[-1][0]


def test_packing_against_the_exact_optimum():
    rng = np.random.default_rng(21)
    more = 0
    for _ in range(150):
        lengths = np.sort(rng.integers(1, 101, rng.integers(2, 11)))[::-1]
        used, least = packing.best_fit(lengths, 100, 100, 10_000, (1.0, 2e-5, 2e-5), "residual")[0].max() + 1, fewest_bins(lengths.tolist(), 100)
        assert least <= used <= 11 / 9 * least + 6 / 9
        more += used > least
    assert more <= 15


# near copies


def brute_components(texts, t=80):
    sets = []
    for text in texts:
        w = text.encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= t * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_copies_against_brute_force(spark):
    rng = random.Random(12)
    base = [[f"b{k}w{rng.randrange(300)}" for _ in range(rng.randrange(5, 120))] for k in range(12)]
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for _ in range(320):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            words += shared
        texts.append(" ".join(words).upper() if rng.random() < 0.2 else " ".join(words))
    texts += ["a b c", "A  b\tc", "a b", "", " ", " ".join(shared)]
    n, component = brute_components(texts)
    rows = {r.doc_id: r for r in jaccard.near_copies(documents(spark, texts)).collect()}
    assert [rows[i].n_shingles for i in range(len(texts))] == n
    assert [rows[i].component_id for i in range(len(texts))] == component
    kept = sorted(r.doc_id for r in jaccard.one_of_each(documents(spark, texts)).collect())
    assert kept == sorted({c for c, size in zip(component, n) if size} | {i for i, size in enumerate(n) if not size})


def test_counts_of_crowded_tokens_go_beyond_a_byte(spark):
    frame = spark.createDataFrame([(i, f"a b c d e f{i}") for i in range(5000)], "doc_id long, text string").coalesce(1)
    with common.Scratch(spark) as scratch:
        join = jaccard.Join(frame, 5, (4, 5), scratch)
        word, n = common.hash_words([b"a b c d e"])
        cell = int(common.shingles(word, n, 5)[0][0].astype(np.int64)) & ((1 << jaccard.CELL_BITS) - 1)
        assert join.classes[cell] == 12 and np.median(join.classes[join.classes > 0]) <= 1


def test_neighbours_with_one_id_for_most_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:600] = x[300]
    ids = [7 if 300 <= i < 800 else 1000 + i for i in range(900)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").coalesce(2)
    index, books = neighbours.build(vectors, sample_rows=300)
    found = collections.defaultdict(list)
    for r in neighbours.search(index, books, neighbours.usable(vectors).where("vec_id >= 1800 or vec_id = 7"), k=15, block_rows=100).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, round(r.score, 9)))
    for q in [7, *range(1800, 1900)]:
        own = min(x[i].tolist() for i in range(900) if ids[i] == q)
        scores = np.einsum("nd,d->n", x.astype(np.float64), np.array(own))
        order = sorted((-scores[i], ids[i]) for i in range(900) if ids[i] != q)[:15]
        assert found[q] == [(i, round(-s, 9)) for s, i in order]


def test_prefix_orders_lose_no_pair():
    rng = np.random.default_rng(13)
    classes = rng.integers(0, 6, 1 << jaccard.CELL_BITS).astype(np.uint8)
    kept, first = collections.Counter(), collections.Counter()
    for _ in range(600):
        x = rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)
        y = np.concatenate([x[rng.random(len(x)) > rng.choice([0.1, 0.25])], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)])
        x, y = (np.unique(v) for v in (x, y))
        both = len(np.intersect1d(x, y))
        if len(y):
            alike = both * 5 >= (len(x) + len(y) - both) * 4
            a, b = jaccard.ordered(x, classes), jaccard.ordered(y, classes)
            assert jaccard.linked(a, b, (4, 5)) == alike
            p, q = jaccard.prefix_length(len(a), (4, 5)), jaccard.prefix_length(len(b), (4, 5))
            more = [b"".join(jaccard.short_prefix(t, m, k).tobytes() for m in jaccard.ORDERS) for t, k in ((a, p), (b, q))]
            allowed = jaccard.orders_allow(a[:p], b[:q], *more, len(a), len(b), (4, 5))
            assert allowed or not alike
            kept[alike] += allowed
            first[alike] += jaccard.prefixes_allow(a[:p], b[:q], len(a), len(b), (4, 5))
    assert kept[False] < first[False]


def test_bands_and_parts_lose_no_pair(spark, monkeypatch):
    for t, s in ((4, 5), (1, 2), (9, 10), (1, 1)):
        n = spark.range(1, 3000).select(F.col("id").alias("n"), jaccard.band(F.col("id"), (t, s)).alias("band")).collect()
        bands = {r.n: r.band for r in n}
        for i in range(1, 3000):
            for j in {i, -(-i * t // s), min(2999, i * s // t)}:
                if j and min(i, j) * s >= max(i, j) * t:
                    assert abs(bands[i] - bands[j]) <= 1
    monkeypatch.setattr(jaccard, "PART_NODES", 3)
    monkeypatch.setattr(jaccard, "MERGED", 2)
    monkeypatch.setattr(jaccard, "PICKED", 0)
    rng = random.Random(22)
    base = [f"w{rng.randrange(40)}" for _ in range(40)]
    texts = [" ".join(base[: rng.randrange(30, 41)] + [f"x{rng.randrange(30)}" for _ in range(rng.randrange(0, 8))]) for _ in range(150)]
    _, component = brute_components(texts)
    rows = {r.doc_id: r.component_id for r in jaccard.near_copies(documents(spark, texts).repartition(7)).collect()}
    assert [rows[i] for i in range(len(texts))] == component


def test_components_of_random_links(spark):
    rng = random.Random(14)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2100)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        parent[b] = a
    found = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "u long, v long"), common.Scratch(spark)).collect()}
    assert found == {i: find(i) for u, v in links if u != v for i in (u, v)}


# licenses


def test_license_scan_against_brute_force(spark):
    rng = random.Random(15)
    filler = "the of this work under version public all rights a to and".split()
    texts = []
    for _ in range(150):
        words = [rng.choice(filler + [f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            _, template = rng.choice(licenses.TEMPLATES)
            own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template)
            if rng.random() < 0.6:
                own[rng.randrange(len(own))] = "zz"
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        texts.append(rng.choice([" ", "-", ", "]).join(w.upper() if rng.random() < 0.3 else w for w in words))
    for r in licenses.scan(documents(spark, texts)).collect():
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", texts[r.doc_id].encode().lower().decode())
        assert r.n_words == len(words)
        places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        assert [(p.start, p.label) for p in r.places] == places
        expected = []
        for number, (label, template) in enumerate(licenses.TEMPLATES):
            own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", template)
            width, kinds = min(max(len(own), math.ceil(len(own) / 0.8 - 1e-9)), len(words)), set(own)
            run = None
            for s in range(len(words) - width + 1) if words else []:
                share = len(kinds & set(words[s : s + width])) / len(kinds)
                if share >= 0.8 - 1e-12:
                    if run and run[3] == s + width - 1:
                        run[3], run[4] = s + width, max(run[4], share)
                    else:
                        run = [label, number, s, s + width, share]
                        expected.append(run)
        assert sorted((b.label, b.template, b.start, b.end, round(b.containment, 9)) for b in r.blocks) == sorted((*e[:4], round(e[4], 9)) for e in expected)


def test_long_templates_find_their_own_text(spark):
    rng = random.Random(23)
    for size in (300, 400, 900):
        words = [f"v{i}" for i in range(size)]
        own = list(words)
        for i in rng.sample(range(size), size // 6):
            own[i] = "zz"
        texts = [" ".join(["a"] * 50 + words + ["b"] * 50), " ".join(own), " ".join(words[: size * 7 // 10])]
        rows = {r.doc_id: r.blocks for r in licenses.scan(documents(spark, texts), templates=(("long", " ".join(words)),)).collect()}
        assert [len(rows[i]) for i in range(3)] == [1, 1, 0]
        assert rows[0][0].containment == 1.0 and 0.8 <= rows[1][0].containment < 0.9


def test_license_lines_get_their_own_label(spark):
    lines = {
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
        "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
        "Licensed under CC BY-NC 4.0 and CC BY 4.0": "cc-by,cc-by-nc",
        "Licensed under the GNU General Public License version 2": "gpl,gpl-2.0",
        "Licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
        "Licensed under the GNU Lesser General Public License version 3": "gpl",
        "released under the MIT license": "mit",
        "released under the BSD license": "bsd",
        "Licensed under the Apache License, Version 2.0": "apache-2.0",
        "Licensed under the Mozilla Public License version 2.0": "",
        "subject to the terms of the Eclipse Public License version 2.0": "",
        "subject to the terms of the Mozilla Public License version 2.0": "mpl-2.0",
        "Dedicated to the public domain under CC0 1.0 Universal": "cc0",
    }
    texts = [around.format(line) for line in lines for around in ("{}", "w1 w2 w3. {}. w4 w5 w6 w7")]
    got = {r.doc_id: r.labels for r in licenses.with_labels(licenses.scan(documents(spark, texts))).collect()}
    assert {texts[i]: got[i] for i in got} == {texts[i]: list(lines.values())[i // 2] for i in range(len(texts))}


def brute_labels(text):
    """Base labels, all labels and score, window by window."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    base = {label for phrase, label in licenses.PHRASES.items() if any(words[i : i + len(phrase.split())] == phrase.split() for i in range(len(words)))}
    labels, best = set(base), 0.0
    for label, template in licenses.TEMPLATES:
        own = re.findall(r"[0-9a-z]+", template)
        need, width = math.ceil(0.8 * len(set(own)) - 1e-9), min(len(words), math.ceil(len(own) / 0.8 - 1e-9))
        met = [i for i in range(len(words) - width + 1) if len(set(own) & set(words[i : i + width])) >= need and len(words) >= need]
        while met:
            n = next((k for k in range(1, len(met)) if met[k] > met[k - 1] + 1), len(met))
            run, met = met[:n], met[n:]
            around = " ".join(words[max(0, run[0] - licenses.AROUND) : run[-1] + width + licenses.AROUND])
            name = licenses.NAMES.get(template)
            if name is None or re.search(name, around):
                labels.add(label)
                best = max(best, *(len(set(own) & set(words[i : i + width])) / len(set(own)) for i in run))
    return ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if base else best


def test_license_labels_and_score_against_brute_force(spark, sf_dir):
    rng = random.Random(12)
    pieces = ["Licensed under CC BY-NC 4.0", "cc by", "All rights reserved", "GNU General Public License version 3", "released under the MIT license", "licensed version", "under the", "4.0", "by sa", "CC", "public domain"]
    texts = [" ".join(rng.choice([*pieces, f"w{rng.randint(0, 9)}", rng.choice(licenses.TEMPLATES)[1]]) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in licenses.with_labels(licenses.scan(documents(spark, texts))).collect()}
    for i, text in enumerate(texts):
        base, labels, score = brute_labels(text)
        assert (rows[i].base_labels, rows[i].labels) == (base, labels) and abs(rows[i].score - score) < 1e-12, text
        assert set(filter(None, base.split(","))) <= set(labels.split(","))


# the queries and the pipeline


def test_pipeline_follows_its_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_copies", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen.append((before, docs))
    (_, good), (_, single), (_, safe), (_, mixed) = seen
    n, component = brute_components([r.text for r in good.orderBy("doc_id").collect()])
    ids = [r.doc_id for r in good.orderBy("doc_id").collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({ids[c] for c in component})
    assert {r.doc_id: r.text for r in safe.collect()} == {r.doc_id: pii.replace(r.text)[0] for r in single.collect()}
    copies = {r.doc_id: r.copies for r in mixing.plan(safe).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {i: c for i, c in copies.items() if c}
    rows = pipeline.run(spark, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in rows if r.piece == 0) == {i: c for i, c in copies.items() if c}


def test_mixing_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    result = con.execute(mixing.OP6_SQL)
    names = [c[0] for c in result.description]
    key = lambda rows: sorted(tuple(sorted((k, repr(v)) for k, v in r.items())) for r in rows)
    assert key(r.asDict() for r in mixing.op6_mixing(spark, sf_dir).collect()) == key(dict(zip(names, r)) for r in result.fetchall())


def test_every_query_is_registered():
    from brandweave.llm import registry

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert os.path.basename(packing.default_tokenizer()) == "byte_bpe_50k.json"
