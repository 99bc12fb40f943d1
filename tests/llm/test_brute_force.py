"""op2, op3 and op4 against plain versions of their methods."""

import datetime
import hashlib
import html.parser
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import prose

from sablevec.llm import html_extract, license_scan, pii

KEY = "key"


def network(l, r, left, right, tweak):
    """Eight rounds that add keyed values to the halves in turn."""
    for i in range(1, pii.ROUNDS + 1):
        x = r if i % 2 else l
        f = int(hashlib.sha256(f"{KEY}:{tweak}:{i}:{x}".encode()).hexdigest()[:14], 16)
        if i % 2:
            l = (l + f % left) % left
        else:
            r = (r + f % right) % right
    return l, r


def number(v, left, right, tweak):
    l, r = network(v // right, v % right, left, right, tweak)
    return l * right + r


def digits(d, tweak):
    a, b = len(d) // 2, len(d) - len(d) // 2
    l, r = network(int(d[:a]), int(d[a:]), 10**a, 10**b, f"{tweak}{len(d)}")
    return f"{l:0{a}d}{r:0{b}d}"


def refill(m, d):
    it = iter(d)
    return "".join(next(it) if c.isdigit() else c for c in m)


def check(d):
    return str(-sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(d))) % 10)


def iban(m):
    z = m.replace(" ", "")
    body = z[4:]
    body = refill(body, digits("".join(c for c in body if c.isdigit()), "iban"))
    mod = int("".join(str(int(c, 36)) for c in body + z[:2] + "00")) % 97
    new = f"{z[:2]}{98 - mod:02d}{body}"
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in m)


def ssn(m):
    area = int(m[:3]) - (2 if int(m[:3]) > 666 else 1)
    v = number((area * 99 + int(m[4:6]) - 1) * 9999 + int(m[7:]) - 1, 88902, 9999, "ssn")
    area = v // 989901
    return f"{area + 1 + (area >= 665):03d}-{v // 9999 % 99 + 1:02d}-{v % 9999 + 1:04d}"


def day(m):
    first = datetime.date(1800, 1, 1)
    v = number((datetime.date.fromisoformat(m) - first).days, *pii.DAY_HALVES, "date")
    return (first + datetime.timedelta(v)).isoformat()


def ip(m):
    v = number(int.from_bytes(bytes(map(int, m.split("."))), "big"), 65536, 65536, "ip")
    return ".".join(str(x) for x in v.to_bytes(4, "big"))


def card(m):
    d = re.sub("[^0-9]", "", m)
    new = digits(d[:-1], "card")
    return refill(m, new + check(new))


def phone(m):
    code = re.match(r"\+([0-9]{1,3})(?=[^0-9]|$)", m)
    code = code[1] if code else ""
    d = re.sub("[^0-9]", "", m)
    return refill(m, code + digits(d[len(code) :], "phone"))


def mail(m):
    return f"user-{hashlib.sha256(f'{KEY}:email:{m.lower()}'.encode()).hexdigest()[:16]}@example.invalid"


def test_pseudonyms_are_the_network_of_plain_numbers(spark):
    r = np.random.default_rng(11)
    texts, want = [], []
    for i in range(60):
        n = "".join(map(str, r.integers(0, 10, 15)))
        body = "".join(map(str, r.integers(0, 10, 24)))
        z = f"HU{98 - int(''.join(str(int(c, 36)) for c in body + 'HU00')) % 97:02d}{body}"
        parts = [
            (m := "-".join(re.findall("....", n + check(n))), card(m)),
            (m := " ".join(re.findall(".{1,4}", z)), iban(m)),
            (m := f"{r.integers(1, 666):03d}-{r.integers(1, 100):02d}-{r.integers(1, 10000):04d}", ssn(m)),
            (m := (datetime.date(1900, 1, 1) + datetime.timedelta(int(r.integers(0, 60000)))).isoformat(), day(m)),
            (m := ".".join(map(str, r.integers(0, 256, 4))), ip(m)),
            (m := f"+{r.integers(1, 99)} ({r.integers(100, 999)}) {r.integers(100, 999)}-{r.integers(1000, 9999)}", phone(m)),
            (m := f"A.{i}@Mail{i % 7}.example.org", mail(m)),
        ]
        texts.append("é " + " ; ".join(a for a, _ in parts) + " end")
        want.append("é " + " ; ".join(b for _, b in parts) + " end")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.report(df, KEY).orderBy("doc_id").collect()
    assert [x.text for x in found] == want
    assert all([x[f"n_{k}"] for k in pii.KINDS] == [1] * 7 for x in found)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def contained(text, name, template, least=0.75):
    """Spans of words where windows hold the share ``least`` of a template."""
    own, all_ = set(shingles(template)), shingles(text)
    s = license_scan.size_class(len(own))
    out = []
    for lo in range(0, len(all_), s):
        places = [i for i in range(lo, min(lo + 2 * s, len(all_))) if all_[i] in own]
        if len({all_[i] for i in places}) >= least * len(own):
            a, b = places[0], places[-1] + 5
            if out and a <= out[-1][2]:
                out[-1][2] = max(out[-1][2], b)
            else:
                out.append([name, a, b])
    return out


def test_licenses_are_those_that_windows_contain(spark):
    r = np.random.default_rng(12)
    t = license_scan.TEMPLATES
    texts = [None, "", "MIT License"]
    for name in sorted(t):
        words = t[name].split()
        for share in (0.0, 0.03, 0.1):  # of words that are changed
            w = [x if r.random() >= share else "changed" for x in words]
            texts.append(f"{prose(int(r.integers(0, 99)), int(r.integers(0, 60)))} {' '.join(w)} {prose(5, 30)}")
    found = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    for text, x in zip(texts, found, strict=True):
        want = [m for name in sorted(t) for m in contained(text, name, t[name])]
        assert [[m.license, m.first_word, m.end_word] for m in x.matches] == want
    whole = {n: x.matches for n, x in zip([None] * 3 + [n for n in sorted(t) for _ in range(3)], found, strict=True) if x.doc_id > 2 and x.doc_id % 3 == 0}
    assert all(n in {m.license for m in whole[n]} for n in t)
    assert "BSD-3-Clause-third" not in {m.license for m in whole["BSD-2-Clause-text"]}


class Plain(html.parser.HTMLParser):
    """Blocks of the element of one class, by the standard library's parser."""

    def __init__(self, wanted):
        super().__init__()
        self.wanted, self.depth, self.inside, self.blocks = wanted, 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "div":
            self.depth += 1
            if self.wanted in dict(attrs).get("class", "").split():
                self.inside = self.depth
        if tag in ("div", "p"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in ("div", "p"):
            self.blocks.append("")
        if tag == "div":
            if self.depth == self.inside:
                self.inside = 0
            self.depth -= 1

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


@pytest.mark.parametrize("wanted,n", [("story", 9), ("extra", 0)])
def test_the_path_of_the_host_decides(spark, wanted, n):
    """On a page whose other container scores better, the text is that of the host's path, and without the host its own."""
    page = "<html><body><div class='extra'><p>{}</p></div><div class='story'><p>{} &amp; <b>more</b></p>\n<p>{}</p></div></body></html>"
    pages = [(i, f"http://news.example/{i}", page.format("see also", prose(i, 80), prose(i + 50, 60))) for i in range(n)]
    pages.append((100, "http://news.example/odd", page.format(prose(200, 150), prose(201, 30), prose(202, 20))))
    found = html_extract.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).orderBy("page_id").collect()
    for (_, _, source), x in zip(pages, found, strict=True):
        plain = Plain(wanted)
        plain.feed(source)
        assert x.text == plain.text() and x.n_chars == len(x.text) > 0
    assert {r.path for r in html_extract.consensus(spark.createDataFrame(pages, "page_id bigint, url string, html string")).select(F.col("path")).collect()} == {f"/body/div.{wanted}"}
