"""Operators on single texts against plain versions of their rules."""

import hashlib
import random
import re
from collections import Counter

import pytest

from martlet.llm import html, language, licenses, quality, secrets, toxicity, urls
from tests.llm.conftest import prose



@pytest.fixture(scope="module")
def url_model(spark):
    return urls.fit(urls.labelled_urls(spark))


ODD = [(None, None), (1, None), (2, ""), (3, " \t\r\n"), (4, "𝒳 é ß"), (5, "a " * 20000), (5, "a " * 20000)]


def test_guess_cost_orders_values():
    cost = secrets.guess_cost
    assert cost("changeme") < cost("qwerty123") < cost("Summer2019") < cost("x9Fq!2vLpZ")
    assert cost("aaaaaaaaaaaa") < cost("akqzmvplwxne") and cost("") == 0


@pytest.mark.parametrize("text, spans", [
    ('token = "abcdefgh12" x', "assign:0:19"), ("api_key: short", ""), ("AKIAABCDEFGHIJKL", "access:0:16"),
    ("é PASSWORD=abcd1234efgh", "assign:2:23"), ("0123456789abcdef0123456789abcdef", "hex:0:32"),
    ("my pwd: x9Fq!2vLpZ ok", "guess:8:18"), ("my pwd: changeme ok", ""), ("the secret is somewhere else", ""),
    ("http://me:Zk3!vQ9x_7Lp@host/", "guess:10:22"), (None, ""), ("", "")])
def test_secret_spans(docs, text, spans):
    row = secrets.digest(docs([(1, text)])).first()
    base = ",".join(s for s in spans.split(",") if s and not s.startswith("guess"))
    assert row["spans"] == spans and row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


@pytest.mark.parametrize("text, start, end", [
    ("Authorization: Bearer x9Fq2vLpZkk81", 22, 35), ("Authorization: Basic bWU6Wms!dlE5eF8=", 21, 37), ("auth: token x9Fq!2vLpZ", 12, 22),
    ("AWS_SECRET_ACCESS_KEY='p@!x9Fq2vLpZ'", 23, 35), ("DB_PASSWORD='x9!..Zq8kW'", 13, 23), ("MYSQL_PWD=x9F!q2vLpZ", 10, 20),
    ("SECRET_VALUE_2: x9F!q2vLpZ", 16, 26), ("pwd: pwd: x9F!q2vLpZ", 10, 20)])
def test_values_behind_schemes_and_joined_names(text, start, end):
    assert secrets.find(text) == [(start, end, "guess")]


@pytest.mark.parametrize("before, value, after", [
    ("Authorization: Bearer ", "eyJ" + "x9Fq2vLpZ_kR" * 80, " "), ("pwd: ", "x9F!q2vLpZ" * 30, " "), ("my ", "ghp_" + "x9Fq2vLpZk" * 60, ","),
    ("http://me:", "x9F!q2vLpZ" * 30, "@host"), ("", "password: Tr0ub4dor&3-Zx!9", " "), ("", "password: " + "x9Fq2vLp&" * 100 + "Z", " ")])
def test_values_are_redacted_whole(before, value, after):
    assert secrets.redact(before + value + after) == before + "[SECRET]" + after


@pytest.mark.parametrize("text, found", [
    ("pwd: xkqzvbtrwmplfh", True), ("passphrase = qhzvtkwplmxr", True), ("bearer xkqzvbtrwmplfh", True), ("the secret was somewhere", False),
    ("pwd: password", False), ("passphrase: Welcome", False)])
def test_cost_decides_on_letters_except_after_is_and_was(text, found):
    assert bool(secrets.find(text)) == found


def test_redaction_keeps_rows_and_counts(docs):
    rows = [(1, 'a token = "abcdefgh12", b'), (2, "plain"), *ODD]
    out = secrets.redact_secrets(docs(rows))
    assert out.columns == docs(rows).columns and out.count() == len(rows)
    first = out.where("doc_id = 1").first()
    assert first["text"] == 'a [SECRET]", b' and first["n_chars"] == len(first["text"])
    assert out.where("doc_id = 2").first()["n_chars"] == 5 and secrets.digest(docs([])).count() == 0


def test_quality_counts_equal_plain_ones(docs):
    rows = [(k, t) for k, t in enumerate(["a b c a b c a", "x x x x", "a b", "One line.\nOne line.\n \nTwo | # $\n", "p q r s\u00a0t p q r",
                                          *[t for _, t in ODD]])]
    for row in quality.digest(docs(rows)).collect():
        text = rows[row["doc_id"]][1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        often, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if often[g] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality_goes_line_by_line(docs):
    good = prose(1, 80)
    rows = [(1, good + "\nHome | News | About | Contact\nAccept all cookies.\nMenu\n" + good.replace("w", "v")),
            (2, good + "\n" + "\n".join(f"a{k} | b{k} | c{k} | d{k}" for k in range(60)))]
    out = {r["doc_id"]: r for r in quality.clean(docs(rows)).collect()}
    assert out[1]["kept"] and out[1]["failed_lines"] == 3 and out[1]["cleaned"] == good + "\n" + good.replace("w", "v")
    assert not out[2]["kept"] and not out[2]["base_failed"] and quality.digest(docs([])).count() == 0


def test_html_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy now, cheap, good, and long enough to score points.</div>
    <article><h1>Head &amp; tail</h1><p><b>First para, with a comma, of some length to score.<br>next
    <p>Second &lt;p&gt;,   also with, some commas and length.</p><form><p>Your name</p></form>
    <div class="comments"><p>First!, well, this is a long reader comment, with commas.</p></div></article>
    <div id="cookie-notice">We use cookies</div><footer>&copy; x</footer></body></html>"""
    assert html.extract(page) == ("Head & tail\n\nFirst para, with a comma, of some length to score. next\n\n"
                                  "Second <p>, also with, some commas and length.")
    assert html.extract("") == "" and html.extract("plain words") == "plain words" and html.extract("<p>a < b <") != ""
    assert html.extract("<div><p>unclosed" + "<div>" * 2000 + "deep, text") != ""


def test_html_article_without_one_element_around_it():
    long = "A long text, with commas, of some length, to score some points, and more. " * 4
    parts = ["Short title", long.strip(), "More", "A short paragraph.", "Loose words"]
    page = "<body><nav>Menu</nav><h1>{}</h1><div>{}</div><h2>{}</h2><p>{}</p>{}<ul><li><a href='/x'>Other page</a></li></ul><footer>x</footer></body>"
    assert html.extract(page.format(*parts)) == "\n\n".join(parts)
    sections = "<body><section><h2>One</h2><div>{}</div></section><section><h2>Two</h2><div>Few words.</div><ul><li>item</li></ul></section></body>"
    assert html.extract(sections.format(long)) == "\n\n".join(["One", long.strip(), "Two", "Few words.", "item"])
    assert html.extract("<body><div>" + long + "</div><div>In <a>brief</a>: words.</div></body>") == long.strip() + "\n\nIn brief: words."


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<p>a</p>"), (3, "v", "<p>a</p>")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.digest(pages).collect()) == [(1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1)]
    assert html.digest(pages.limit(0)).count() == 0


LONG = "A paragraph, with commas, and enough words to count as one. It goes on, and ends."


def test_html_keeps_what_only_looks_like_a_menu():
    """Names are taken whole, for blocks only, and do not take the article away."""
    for page, text in (
            ('<div class="post comments-open"><p>{0}</p></div>', "{0}"),
            ('<div id="content" class="search"><p>{0}</p></div>', "{0}"),
            ('<div class="search"><p>{0}</p></div>', "{0}"),
            ('<article><header class="entry-header"><h1>Title</h1></header><p>{0}</p></article>', "Title\n\n{0}"),
            ('<article><h2 class="related-work">Related</h2><p class="notice-period">{0}</p></article>', "Related\n\n{0}"),
            ('<article><p>An <span class="social">inner</span> word. {0}</p></article>', "An inner word. {0}"),
            ('<article><p>Press <button>Go</button> or <svg><path d="M0"/></svg> now, <input type=text> wait. {0}</p></article>',
             "Press or now, wait. {0}")):
        assert html.extract(f"<body>{page.format(LONG)}</body>") == text.format(LONG), page
    beside = f"<article><h1>T</h1></article><div class='ad'>{LONG * 3}</div>"
    assert html.extract(beside) == "T"
    for name in ("site-footer", "share-buttons", "cookie-banner", "main-nav", "comments", "ad-slot", "related-posts"):
        assert html.extract(f"<div class='x {name}'>{LONG}</div><div>{LONG * 3}</div>") == LONG * 3, name


def plain_main(tree):
    """Blocks of a made-up tree, without what is left out: (tag, class, children or text)."""
    tag, name, inner = tree
    if tag in ("nav", "footer", "aside", "form", "script") or name in ("ad", "sidebar", "comments"):
        return []
    if isinstance(inner, str):
        return [inner]
    return [text for child in inner for text in plain_main(child)]


def test_html_of_made_up_trees():
    dice = random.Random(11)

    def tree(depth):
        kind = dice.random()
        words = " ".join(dice.choice(["one,", "two", "three", "four&amp;"]) for _ in range(dice.randint(8, 30)))
        if depth == 0 or kind < 0.5:
            return dice.choice(["p", "h2", "blockquote"]), "", words
        if kind < 0.7:
            return dice.choice([("nav", "", words), ("aside", "", words), ("script", "", "x = 1"), ("div", "ad", words), ("section", "sidebar", words)])
        return dice.choice(["div", "section"]), "", [tree(depth - 1) for _ in range(dice.randint(1, 4))]

    def written(t):
        tag, name, inner = t
        body = inner if isinstance(inner, str) else "\n".join(map(written, inner))
        return f"<{tag}{' class=' + name if name else ''}>{body}</{tag}>"

    for _ in range(60):
        whole = ("article", "", [("p", "", f"{LONG} {LONG}"), *(tree(4) for _ in range(5))])
        page = f"<html><body><nav><a href=x>Menu</a></nav>{written(whole)}<footer>End</footer></body></html>"
        assert html.extract(page) == "\n\n".join(t.replace("&amp;", "&") for t in plain_main(whole))


def test_html_takes_linear_time():
    import time
    for part in ("<div>", '<a "', "<a '><'", "<!--", "< ", "<p><div>", "<ul><li>", "<table><tr><td>", "<article><nav>"):
        start = time.process_time()
        html.extract(part * 50_000 + "x, y")
        assert time.process_time() - start < 5, part


def test_html_keeps_other_columns(spark):
    odd = spark.createDataFrame([(1, "u", "<p>a</p>", "x", 2)], "page_id long, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html.digest(odd).collect()] == [(1, "u", "a", 1)]
    assert html.main_text(odd).columns == ["page_id", "url", "text", "n_chars", "_llm_main"]


@pytest.mark.parametrize("text, n, places, first, last, base, labels", [
    ("Licensed under CC BY-NC 4.0.", 7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc"), ("cc by cc by", 4, 2, 0, 2, "cc-by", "cc-by"),
    ("GNU General Public License, version 3. All rights reserved.", 9, 2, 1, 6, "gpl,reserved", "gpl,gpl-3.0,reserved"),
    ("Released under the MIT License.", 5, 0, None, None, "", "mit"), ("under the Apache License, Version 2.0", 7, 0, None, None, "", "apache-2.0"),
    ("nothing of that é", 4, 0, None, None, "", ""), (None, 0, 0, None, None, "", ""), ("", 0, 0, None, None, "", "")])
def test_licenses(docs, text, n, places, first, last, base, labels):
    row = licenses.digest(docs([(1, text)])).first()
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (n, places, first, last, base)
    assert set(labels.split(",")) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1


@pytest.mark.parametrize("space", [" ", "\n", "  ", "\r\n", "\u00a0"])
@pytest.mark.parametrize("text, label", [
    ("GNU General Public License version 3", "gpl-3.0"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("Redistribution and use in source and binary forms", "bsd"), ("Permission to use, copy, modify, and distribute this software", "isc"),
    ("dedicated to the public domain", "public-domain"), ("released under the GPL", "gpl"), ("CC BY 4.0", "cc-by"), ("the SIL Open Font License", "ofl-1.1"),
    ("Common Development and Distribution License", "cddl"), ("GNU Free Documentation License", "gfdl"), ("European Union Public License", "eupl"),
    ("Open Database License", "odbl"), ("GNU Library General Public License", "lgpl"), ("the Expat License", "mit")])
def test_wrapped_license_statements_are_found(text, label, space):
    _, _, found = licenses.scan_text(text.replace(" ", space).encode())
    assert label in {x for _, _, x, _ in found}


def test_license_keywords_are_single_words():
    assert not [r.keyword for r in licenses.RULES if re.search(r"\s", r.keyword)]


def test_toxic_clauses_and_learning(spark, docs):
    kinds = lambda s: [k for _, k in toxicity.clauses(s.encode())]
    assert kinds("He is not an idiot.") == [toxicity.DENIED] and kinds("She said idiot.") == [toxicity.TOLD]
    assert kinds("You idiot.") == [toxicity.AIMED] and kinds("I will kill you.") == [toxicity.MENACE] and kinds("Kill the process.") == []
    rows = [(k, prose(k) + (" you moron" if k % 3 == 0 else " the freaks")) for k in range(120)] + [(k, t) for k, t in ODD]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(120)] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    out = toxicity.digest(docs(rows), labels).collect()
    assert len(out) == len(rows)
    assert all(r["predicted"] == (r["doc_id"] is not None and 5 < r["doc_id"] and r["doc_id"] % 3 == 0)
               for r in out if r["doc_id"] is not None and r["doc_id"] > 5)
    kept = toxicity.drop_toxic(docs(rows), labels)
    assert kept.columns == docs(rows).columns and kept.where("text LIKE '%moron'").count() == 0
    assert toxicity.digest(docs([]), labels.limit(0)).count() == 0


def test_language(docs):
    said = {"en": "the house of the people and that which they have been with", "de": "das haus und der mann nicht mit einer frau auf dem",
            "fr": "la maison est dans une rue avec les enfants qui", "es": "la casa es para los hombres que con una mujer del"}
    rows = [(k, " ".join(w for i, w in enumerate(said[lang].split()) if (i + k) % 4), lang) for k, lang in enumerate(list(said) * 30)]
    rows += [(1000, None), (1001, "123 !!"), (1002, "")]
    out = {r["doc_id"]: r for r in language.digest(docs(rows)).collect()}
    assert all(out[k]["lang_pred"] == "und" for k in (1000, 1001, 1002))
    held = [r for r in rows if r[0] < 1000 and out[r[0]]["held_out"]]
    assert held and all(out[k]["lang_pred"] == lang for k, _, lang in held)
    assert language.digest(docs([(1, "text", None)])).first()["lang_pred"] == "und"


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://x.org/en/12", "x.org", "/en/12", "org/", "allow"),
    ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"), ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"),
    ("http://casino-bets.net/en/1", "casino-bets.net", "/en/1", None, "block"), ("http://notexample.org", "notexample.org", "", None, "allow"),
    ("x://h?a/b", "h", "", None, "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow")])
def test_urls(spark, url_model, url, host, path, rule, verdict):
    table = url_model
    found, at = urls.host_and_path(urls.F.col("url"))
    one = spark.createDataFrame([(url,)], "url string").select(found.alias("h"), at.alias("p"))
    says, means = urls.ruled(urls.F.col("h"), urls.F.col("p"), urls.RULES)
    row = one.select("h", "p", says.alias("r"), means.alias("v"), urls.chance(urls.buckets(urls.F.col("h"), urls.F.col("p")), *table).alias("c")).first()
    assert (row["h"], row["p"], row["r"]) == (host, path, rule)
    assert (row["v"] or ("block" if row["c"] >= urls.LIMIT else "allow")) == verdict


def test_toxic_stems_are_learned_from_labels(spark):
    """A word start that only toxic teaching documents repeat is an insult; denied or single ones are not enough."""
    clean = [(i, f"plain talk number {i} of the town and the river", 0) for i in range(300)]
    toxic = [(1000 + i, f"you zorgaba and zorgeto again {i} here", 1) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in clean + toxic] + [(None, None), (5000, ""), (5001, "not zorgaba not zorgeto")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in clean + toxic] + [(None, 1), (7, None)], "doc_id long, toxic int")
    stems = toxicity.learn_stems(docs, labels)
    assert stems.starts == {"zorg"}
    found = {r["doc_id"]: r["predicted"] for r in toxicity.digest(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(found[i] == y for i, _, y in clean + toxic)
    assert found[5000] == found[5001] == found[None] == 0
    nothing = toxicity.learn_stems(docs, labels.limit(0))
    assert nothing == toxicity.Stems()
    assert toxicity.learn_stems(docs.limit(0), labels) == toxicity.Stems()
    one_kind = toxicity.learn_stems(docs, labels.where("toxic = 1"))
    assert one_kind.starts == {"zorg"} and 0 <= one_kind.chance(2, 8) <= 1


def test_license_detections_against_all_pairs():
    """Kept are those that no earlier one in order contains, however many there are."""
    text = " ".join(dice for k in range(40) for dice in (
        "Released under the MIT License.", "SPDX-License-Identifier: Apache-2.0", "licensed under the GNU General Public License, version 3",
        "Permission is hereby granted, free of charge, to any person", "Creative Commons Attribution 4.0 International License")[k % 3:k % 5 + 1])
    low = text.lower()
    found = sorted(((r.priority, m.start(), m.end(), r.label, r.confidence) for r in licenses.RULES for m in r.pattern.finditer(low)
                    if r.keyword in low), key=lambda d: (d[0], d[1] - d[2], d[1], -d[4], d[3]))
    kept = []
    for d in found:
        if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
            kept.append(d)
    assert kept and licenses.detections(low) == sorted(d[1:] for d in kept)
    import time
    start = time.process_time()
    licenses.detections("released under the mit license. " * 20_000)
    assert time.process_time() - start < 10
