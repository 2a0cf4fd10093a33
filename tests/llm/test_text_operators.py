"""Anchors, lexing, media, BPE and page extraction against plain versions."""

import hashlib
import html
import random
import re

import numpy as np
import pytest

from gridspark.llm import bpe, html_main, mpeg, pii, secrets


def _luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def plain_secrets(t):
    key = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    out = [(m.start(), 0, m.end()) for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


PII_PARTS = ["1", "2", "255", "300", "4", "0", ".", ".", "@", "a", "b.c", "-", " ", "+", "+1", "(", ")", "é", "٣", "com", "://", "IBAN ", "SSN ", " Street", "1111", "4111 1111 1111 1111", "4111111111111111", "Main"]
KEY_PARTS = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", '"', "'", " ", ":", "=", "abc", "123", "+", "/", ".", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "\n", "é", "ſecret", "toKen", "-"]


def test_pii_base_matches_plain_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice(PII_PARTS) for _ in range(rng.randint(0, 18)))
        assert [(s, pii.ORDER[k], e) for s, k, e in pii.find(t) if k in pii.BASE] == plain_pii(t), t


def test_pii_extra_kinds_and_redaction():
    t = "Pay to IBAN GB82 WEST 1234 5698 7654 32 or visit 12 Old Market Street, SSN: 123-45-6789; see ftp://bob:pw@host.org/x and a.b@c.de"
    found = {k: t[s:e] for s, k, e in pii.find(t)}
    assert found["iban"] == "GB82 WEST 1234 5698 7654 32"
    assert found["address"] == "12 Old Market Street"
    assert found["ssn"] == "123-45-6789"
    assert found["account"] == "bob:pw"
    clean = pii.redacted(t, pii.find(t))
    assert "<IBAN>" in clean and "a.b@c.de" not in clean and "123-45" not in clean
    assert not [x for x in pii.find("IBAN GB82 WEST 1234 5698 7654 33, SSN 000-12-3456, 123456 Big Street") if x[1] in ("iban", "ssn", "address")]


def test_secrets_base_matches_plain_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        t = "".join(rng.choice(KEY_PARTS) for _ in range(rng.randint(0, 18)))
        assert [(s, secrets.ORDER[k], e) for s, k, e in secrets.find(t) if k != "pair"] == plain_secrets(t), t


def test_secrets_follow_constants():
    t = 'base = "q8Zr41LmXw77"\nother = "hello"\ndb_password = base + "9aVb3"\ncolour = "blue-green-teal"\n'
    pairs = [t[s:e] for s, k, e in secrets.find(t) if k == "pair"]
    assert pairs == ["q8Zr41LmXw77", "9aVb3"]
    assert [k for _, k, _ in secrets.find('{"client_secret": "Zx81kQ0pLmN4"}')] == ["assign", "pair"]
    assert not [x for x in secrets.find('title = "The quick brown fox"\npublic_key_path = "/etc/ssl/cert.pem"') if x[1] == "pair"]


def test_mpeg_round_trip_and_tables():
    rng = random.Random(2)
    for n in (0, 1, 191, 192, 193, 936, 937, 938, 5_000, 200_000):
        payload = mpeg.padded(bytes(rng.randrange(256) for _ in range(n)))
        assert len(payload) % 192 == 0 and payload
        s = mpeg.demux(mpeg.mux(payload))
        assert s.payload == payload and s.skipped == 0 and s.bad_checksums == 0
        assert s.xing_frames == len(s.offsets) and s.samples == 1152 * len(s.offsets) and len(s.toc) == 100
        assert s.seek(0) == s.offsets[0] and s.seek(s.samples - 1) == s.offsets[-1]


def test_mpeg_resynchronises_and_reports_damage():
    payload = mpeg.padded(b"ab" * 4000)
    data = mpeg.mux(payload)
    whole = mpeg.demux(data)
    cut = whole.offsets[3]
    s = mpeg.demux(data[:cut] + b"\xff\xfbjunk\xff\xff" + data[cut:])
    assert s.payload == payload and s.skipped == 8
    broken = bytearray(data)
    broken[whole.offsets[2] + 8] ^= 1  # inside the checked side information
    assert mpeg.demux(bytes(broken)).bad_checksums == 1
    assert mpeg.demux(b"").offsets == [] and mpeg.demux(bytes(500)).skipped == 500


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={}), bpe.Coder(path)


def test_bpe_equals_the_library(library):
    plain, own = library
    rng = random.Random(1)
    parts = ["'", "'s", "'re", "'ll", "l", "r", "e", "v", "s", " ", "  ", "\n", "\t", "a", "B", "1", "٣", "é", "!", "…", "　", "\xa0", "日", "🙂", "\0", "\x1c", "ſ", "Ⅷ", "²", "\x85"]
    docs = ["", "a" * 3000, " " * 2000, "ab'" * 500, "x" * 401 + "yz" * 300] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    for k in range(0, len(docs), 100):
        for d, (ids, at) in zip(docs[k : k + 100], own.encode(docs[k : k + 100])):
            ids = np.frombuffer(ids, "<u4").tolist()
            assert ids == plain.encode_ordinary(d), d
            assert own.decode(ids) == d.encode()
            assert len(at) == len(set(at))


def test_bpe_scan_equals_a_sequential_automaton():
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, 11, 3000).astype(np.uint8)
    state, out = 0, []
    for k in kinds:
        state = int(bpe.STEPS[k, state])
        out.append(state)
    assert bpe.states(kinds).tolist() == out


def test_pages_give_the_article(spark):
    model = html_main.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    for markup, got in zip(pages.html, html_main.extract(pages.html.tolist(), model)):
        inner = re.search(r"<article>(.*?)</article>", markup, re.S)[1]
        inner = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner)
        assert got == " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
    unseen = random.Random(77)
    xs, ys = zip(*(html_main._composed_rows(["alpha", "beta", "gamma,", "delta."], unseen) for _ in range(60)))
    hit = (model.predict(np.concatenate(xs)) > 0.5) == np.concatenate(ys)
    assert hit.mean() > 0.95
    page = html_main.parse("<div class=sidebar><p>no</p><ul><li>yes?</ul></div><article><h1>A &amp; B</h1><p>one<b>two</b><br>three <p>four")
    keep = html_main.decode(page, np.full(len(page.nodes), 0.9))
    assert html_main.joined(page, keep) == "no yes? A & B onetwo three four"
    p = np.full(len(page.nodes), 0.9)
    p[1] = 1e-9  # a dropped node drops all below it, however likely
    assert html_main.joined(page, html_main.decode(page, p)) == "A & B onetwo three four"
    assert html_main.extract(["", "<p>", "plain < text", "<div" * 50], model)[0] == ""


def test_digests_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(pii.spans_text(pii.find(None)).encode()).hexdigest()
    assert secrets.find("") == [] and pii.find("") == []


def test_hostile_texts_take_linear_time():
    from gridspark.llm import toxicity

    n = 200_000
    for t in (":" * n, "k=a+a" * (n // 5), "token=" * (n // 6), "= " * n, "a" * n + "@", "+1" * n, "1." * n, "1 " * n, " St." * n, "A" * n + " St." * 50, "://" * n):
        secrets.find(t)
        pii.find(t)
    for t in ("<b>" * n + "</i>" * n, "<p>" * n, "<div>" * 20_000, "<" * n, "<a href='" * 20_000, "&amp" * n, "</p>" * n):
        html_main.features(html_main.parse(t))
    channel = toxicity.Channel(np.ones(28**3))
    assert len(channel.restore("a1" * 50_000)) >= 50_000
    assert channel.restore("x" * n).strip("x") == ""


def test_secrets_of_any_length_and_number_of_terms():
    rng = random.Random(12)
    blob = lambda n: "".join(rng.choice("ABCDEFGHKMabcdefghkm23456789") for _ in range(n))
    pairs = lambda t: [t[s:e] for s, k, e in secrets.find(t) if k == "pair"]
    long, parts = blob(3000), [blob(9) for _ in range(60)]
    for name in ("auth_key", "signing_key", "credentials", "client_secret_value"):
        assert pairs(f'{name} = "{long}"') == pairs(f"{name} = {long}\n") == [long]
        assert pairs(f'{name} = "{long}" + "{parts[0]}"') == [long, parts[0]]
    assert pairs("signing_key = " + " + ".join(f'"{p}"' for p in parts)) == parts
    lines = ['k = "' + parts[0] + '"', *(f'k = k + "{p}"' for p in parts[1:])]
    assert pairs("\n".join(lines) + "\nsigning_key = k") == parts
    assert pairs("x" * 300 + "_auth_key = '" + parts[0] + "'") == pairs("auth_key" + " " * 100 + "= '" + parts[0] + "'") == [parts[0]]


def test_shared_and_doubled_values_take_linear_time():
    n = 100_000
    doubled = "".join(f"b{i + 1}=b{i}+b{i}\n" for i in range(n // 10)) + "token=b1"
    for t in ("token=x+" * (n // 8), "a=a+a\n" * (n // 6), doubled, "token=a+token\n" * (n // 14), "token" * (n // 5) + ":" * n, "token=" * (n // 6) + "+ " * n, "auth_key='" + "ab1" * n + "'", '="\\' * n):
        secrets.find(t)


def test_head_without_end_tag():
    def read(markup):
        page = html_main.parse(markup)
        return html_main.joined(page, [True] * len(page.nodes))

    head = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><script>var a = '<p>'</script><link rel=x href=y>\n"
    body = "<article><h1>A</h1><p>one two</p></article>"
    for begin in ("<body>", "<body class=x>", "", "</head><body>", "<head><body>"):
        assert read(f"<!DOCTYPE html>{head}{begin}{body}") == "A one two", begin
    assert read(f"{head}plain <b>bold</b>{body}") == "plain bold A one two"
    assert read(f"{head}<img src=x>first{body}</body></html>") == "first A one two"
    assert read("<head><title>T</title><style>p {}</style>") == ""
    assert len(html_main.parse(head + body).nodes) == len(html_main.parse(head + "</head>" + body).nodes)


def test_sibling_features_of_long_flat_pages():
    words = [1 + (7 * k) % 23 for k in range(200)]
    page = html_main.parse("<main>" + "".join(f"<p><a>{'x' * n}</a></p>" if k < 150 else f"<ul>{'x' * n}</ul>" for k, n in enumerate(words)) + "</main>")
    (core,) = page.nodes[0].children
    kin = page.nodes[core].children
    rows = html_main.features(page)[kin]
    assert rows[:, 8].tolist() == list(range(200))
    assert np.allclose(rows[:, 10], [0.75] * 150 + [0.25] * 50)
    assert np.allclose(rows[:, 12], np.log1p([0, *words[:-1]])) and np.allclose(rows[:, 13], np.log1p([*words[1:], 0]))


def test_pii_cues_reach_as_far_as_their_line_or_name():
    found = lambda t, kind: [t[s:e] for s, k, e in pii.find(t) if k == kind]
    gap = "of the account that was opened in the spring, which is "
    assert found(f"the SSN {gap}123-45-6789 ssn", "ssn") == ["123-45-6789"]
    assert found(f"IBAN {gap}GB82WEST12345698765432.", "iban") == ["GB82WEST12345698765432"]
    assert found("SSN\n123-45-6789", "ssn") == [] and found("IBAN\nGB82WEST12345698765432", "iban") == []
    assert found("at 12 Old Saint Mary Of The Great Hill Market Street, Town", "address") == ["12 Old Saint Mary Of The Great Hill Market Street"]
    assert found("SSN 123-45-6789 and SSN 223-45-6789 or SSN: none", "ssn") == ["123-45-6789", "223-45-6789"]
    n = 50_000
    for t in ("ssn " * n, "IBAN " * n, "Word Street " * n, "1 Street" * n, "Aa " * n + " Street" * 200):
        pii.find(t)


def plain_extra_pii(t):
    """IBAN and SSN by patterns over the line of a cue: the first identifier behind the first cue that isn't used yet."""
    out = []
    for m in re.finditer(r"SSN|ssn", t):
        digit = re.compile(r"[^0-9\n\r]*").match(t, m.end()).end()
        n = re.compile(r"(?!000|666|9)[0-9]{3}([ -])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9])").match(t, digit)
        if n:
            out.append((n.start(), n.end()))
    return sorted(set(out))


def test_pii_numbers_match_a_plain_pattern():
    rng = random.Random(21)
    parts = ["SSN", "ssn ", "123-45-6789", "123 45 6789", "666-12-1234", "is ", "\n", "x", "1", "219-09-9999"]
    for _ in range(5_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert [(s, e) for s, k, e in pii.find(t) if k == "ssn"] == plain_extra_pii(t), t


def test_secrets_of_blocks_calls_and_phrases():
    pairs = lambda t: [t[s:e] for s, k, e in secrets.find(t) if k == "pair"]
    block = "spec:\n  private_key: |\n    k3JxP0aa91LmQw\n    Zz82hfTqpo1144\n  name: x\n"
    assert pairs(block) == ["k3JxP0aa91LmQw\n    Zz82hfTqpo1144"]
    assert pairs("signing_key = '''Ab12Cd34Ef56Gh78'''") == pairs('signing_key = """Ab12Cd34Ef56Gh78"""') == ["Ab12Cd34Ef56Gh78"]
    assert pairs('client.setPassword("Xy81kQ0pLmN4")') == ["Xy81kQ0pLmN4"] and pairs('getenv("API_KEY_NAME1")') == []
    assert pairs('ask_password("Please type it in here")') == []
    assert pairs('passphrase = "correct horse battery staple 42"') == ["correct horse battery staple 42"]
    assert pairs('auth_key = "Zx81kQ0pLm" + "N4" + "b"') == ["Zx81kQ0pLm", "N4", "b"]
    assert pairs('db_password = "it\\"s9Kq81Lm"') == ['it\\"s9Kq81Lm'] and pairs("title = 'some words of prose'") == []
    n = 30_000
    for t in ("a: |\n" * n, "k: |\n  a: |\n" * n, "='''" * n, "='''=\"\"\"" * n, "x('" * n, "password('" * n, "a(\"" * n + "b"):
        secrets.find(t)


def _unnamed_page(words, rng):
    """A page without any telling element or name, and its main text."""
    prose = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b))) + rng.choice(".,.?!")
    name = lambda: rng.choice(["", ' class="x1"', f' class="c-{rng.randint(1, 99)}"', f' id="a{rng.randint(1, 99)}"', ' class="foo bar"'])
    links = lambda k: "<ul>" + "".join(f'<li><a href="#">{prose(1, 4)}</a></li>' for _ in range(k)) + "</ul>"
    heading, blocks = prose(3, 9), [prose(8, 80) for _ in range(rng.choice([2, 3, 5, 9, 15]))]
    parts = [f"<div{name()}>{links(rng.randint(3, 9))}</div>", f"<div{name()}><h1>{heading}</h1>" + "".join(f"<p>{b}</p>" for b in blocks) + "</div>"]
    parts += [f"<div{name()}><h3>{prose(1, 3)}</h3>{links(rng.randint(3, 7))}</div>"] * (rng.random() < 0.5)
    parts += [f'<div{name()}><p>&copy; {prose(3, 8)}</p><a href="#">{prose(1, 2)}</a></div>'] * (rng.random() < 0.7)
    return f"<html><body>{''.join(parts)}</body></html>", " ".join([heading, *blocks])


def test_articles_without_telling_names(spark):
    model = html_main.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    rng = random.Random(5)
    made = [_unnamed_page(["alpha", "beta", "gamma,", "delta."], rng) for _ in range(300)]
    got = html_main.extract([m for m, _ in made], model)
    assert sum(g == want for g, (_, want) in zip(got, made)) >= 285


def test_decode_equals_the_best_of_all_labellings():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 10))
        page = html_main.Page([html_main.Node("#page", -1, 0, ())])
        for k in range(1, n):
            page.nodes.append(html_main.Node("div", int(rng.integers(0, k)), 1, ()))
        p = rng.uniform(0.01, 0.99, n)
        best, best_value = None, -np.inf
        for mask in range(1 << n):
            keep = [bool(mask >> k & 1) for k in range(n)]
            if keep[0] and all(not keep[k] or keep[page.nodes[k].parent] for k in range(1, n)):
                value = sum(np.log(p[k]) if keep[k] else np.log(1 - p[k]) for k in range(n))
                if value > best_value:
                    best, best_value = keep, value
        assert html_main.decode(page, p) == best


def test_boosted_trees_equal_a_plain_version():
    from gridspark.llm.gbt import BoostedTrees

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = BoostedTrees(rounds=5, depth=2, bins=8)
    got = trees.fit(x, y).predict(x)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 9)[1:-1])) for k in range(3)]
    b = np.array([[sum(e < v for e in edges[k]) for k, v in enumerate(row)] for row in x])
    z = np.full(400, np.log((y.sum() + 0.5) / (401 - y.sum() - 0.5)))

    def grow(rows, g, h, depth):
        if depth:
            best = (1e-6, None)
            for k in range(3):
                for cut in range(8):
                    low = rows[b[rows, k] <= cut]
                    high = rows[b[rows, k] > cut]
                    if min(h[low].sum(), h[high].sum()) >= 2.0:
                        gain = sum(g[r].sum() ** 2 / (h[r].sum() + 1) for r in (low, high)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, (low, high))
            if best[1]:
                for part in best[1]:
                    grow(part, g, h, depth - 1)
                return
        z[rows] -= 0.2 * g[rows].sum() / (h[rows].sum() + 1)

    for _ in range(5):
        p = 1 / (1 + np.exp(-z))
        grow(np.arange(400), p - y, p * (1 - p), 2)
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
