import random

from gridlark.llm.html_text import build_tree, extract_text, render


def text(source):
    return render(build_tree(source))


def test_spacing_lists_and_hidden_parts():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body>
    <nav><ul><li><a href=x>Home</a><li>About us</ul></nav><!-- <p>no</p> -->
    <h1>Head  line</h1><p>One <b>two</b>
    three<br>four<p hidden>no</p><p style="display: none">no<p>Five &amp; six&nbsp;x</p>
    <script>var t = "</p>no";</script><div>a</div><div>b</div>
    <ol start=3><li>x<ul><li>y<li>z</ul><li><p>u</p><p>v</p></ol>end<pre>  k
  l</pre></body></html>"""
    assert text(page) == "\n".join(
        ["- Home", "- About us", "", "Head line", "", "One two three", "four", "", "Five & six x", "", "a", "b", "", "3. x", "   - y", "   - z", "", "4. u", "", "   v", "", "end", "", "  k", "  l"]
    )


def test_tables_with_implied_tags_are_aligned():
    page = "<p>t<table><caption>Cap</caption><tr><th>a<th>bbb<tr><td>cccc<td>d<tr><td colspan=2>wide cell here<tr><td>x<table><tr><td>in<td>ner</table><td>y</table>after"
    lines = text(page).split("\n")
    assert lines[:3] == ["t", "", "Cap"]
    assert [x for x in lines if "|" in x][:2] == ["a        | bbb", "cccc     | d"]
    assert "wide cell here" in lines and "in | ner" in "\n".join(lines) and lines[-1] == "after"


def test_odd_pages():
    assert text("") == ""
    assert text("a < b > c & d") == "a < b > c & d"
    assert text("x<!-- open") == "x"
    assert text("</p></div>y</table>") == "y"
    assert text('<p title="a>b">z</p>') == "z"
    assert text("<textarea>a<b>c</textarea>") == "a<b>c"
    assert text("<div>" * 20_000 + "deep") == "deep"
    assert text("<td>lone<td>cells").replace("\n", " ") == "lone cells"
    assert len(text("<p>word " * 20_000).split()) == 20_000


def test_head_and_body_tags_may_be_left_out():
    assert text("<head><title>T</title><p>Hello <b>you</b><p>x") == "Hello you\n\nx"
    assert text("<!DOCTYPE html><html><head>\n<meta charset=utf-8><title>T</title>\n<style>p{}</style>\nplain text<div>d</div></html>") == "plain text\nd"
    assert text("<head><title>T</title><link rel=x><script>no</script><base href=y><!-- no --> <h1>H</h1><title>no</title>z") == "H\n\nz"
    assert text("<head><noscript><img src=x>no</noscript><template><p>no</p></template><title>T</title></head>y") == "y"
    assert text("<head><title>T</title><body>a</body>") == "a"
    assert text("<head>&#32;<title>T</title>&amp;") == "&"
    assert text("<head><head><title>T</title><table><tr><td>a<td>b</table>") == "a | b"


def test_round_trip_of_random_pages():
    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "béta", "g&amp;d", "x", "longer-word"])
    plain = lambda w: w.replace("&amp;", "&")
    for _ in range(200):
        source, blocks = [], []
        for _ in range(rng.randrange(1, 8)):
            kind = rng.choice(["p", "h2", "ul", "ol", "table", "hidden"])
            if kind in ("p", "h2"):
                words = [word() for _ in range(rng.randrange(1, 9))]
                source.append(f"<{kind}>" + rng.choice([" ", "\n  "]).join(f"<i>{w}</i>" if rng.random() < 0.3 else w for w in words) + ("" if kind == "p" and rng.random() < 0.5 else f"</{kind}>"))
                blocks.append(" ".join(map(plain, words)))
            elif kind in ("ul", "ol"):
                items = [word() for _ in range(rng.randrange(1, 5))]
                source.append(f"<{kind}>" + "".join(f"<li>{w}" + rng.choice(["", "</li>", "\n"]) for w in items) + f"</{kind}>")
                blocks.append("\n".join((f"{k}. " if kind == "ol" else "- ") + plain(w) for k, w in enumerate(items, 1)))
            elif kind == "table":
                rows = [[word() for _ in range(3)] for _ in range(rng.randrange(1, 4))]
                wide = [max(len(plain(r[c])) for r in rows) for c in range(3)]
                source.append("<table>" + "".join("<tr>" + "".join(f"<td>{w}" + rng.choice(["", "</td>"]) for w in r) for r in rows) + "</table>")
                blocks.append("\n".join(" | ".join(plain(w).ljust(wide[c]) for c, w in enumerate(r)).rstrip() for r in rows))
            else:
                source.append(rng.choice(["<div hidden>no<p>no</div>", "<script>no</script>", "<!-- no -->", "<p style='visibility:hidden'>no</p>"]))
        assert text("".join(source)) == "\n\n".join(blocks)


def test_operator_over_tables(spark):
    rows = [(1, None, "n"), (2, "", "n"), (3, "<p>a<p>b", None), (3, "<p>a<p>b", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(map(tuple, extract_text(df).collect()), key=str)
    assert got == [(1, None, 0, 0), (2, "", 0, 0), (3, "a\n\nb", 4, 3), (3, "a\n\nb", 4, 3)]
    assert extract_text(df.where("page_id > 9")).count() == 0


def naive(blocks, seen):
    """(spaced, lines) of each block of a tree of ``grow``: a second, plain layout by recursion."""
    out = []
    for kind, *rest in blocks:
        if kind == "p":
            out.append((True, [" ".join(rest[0])] if seen else []))
        elif kind == "div":
            out += [(False, []), *naive(rest[0], seen), (False, [])]
        elif kind == "gone":
            continue
        elif kind in ("unseen", "seen"):
            out += [(False, []), *naive(rest[0], kind == "seen"), (False, [])]
        elif kind == "details":
            out += [(False, [" ".join(rest[1])] if seen else []), *(naive(rest[2], seen) if rest[0] else [])]
        elif kind == "svg":
            out += [(False, [w] if seen else []) for w in rest[0]]
        else:
            out.append((True, naive_table(rest[0], seen)))
    return out


def naive_table(rows, seen):
    owner, width = {}, {}
    for r, row in enumerate(rows):
        c = 0
        for n, (across, down, word) in enumerate(row):
            while (r, c) in owner:
                c += 1
            for i in range(down):
                for j in range(across):
                    owner[r + i, c + j] = (r, n, c, word if seen else "")
            c += across
    for across in (1, 2, 3):
        for r, row in enumerate(rows):
            for n, (span, _, word) in enumerate(row):
                if span == across and seen:
                    at = [c for (rr, c), o in owner.items() if rr == r and o[:2] == (r, n)]
                    short = len(word) - sum(width.get(c, 0) for c in at) - 3 * (len(at) - 1)
                    width[max(at)] = width.get(max(at), 0) + max(0, short)
    lines = []
    for r, row in enumerate(rows):
        if not row or not seen:  # cells without texts have no lines
            continue
        last = max(c for (rr, c), o in owner.items() if rr == r and o[0] == r)
        parts, c = [], 0
        while c <= last:
            o = owner.get((r, c))
            wide = [k for k in range(c, last + 1) if o and owner.get((r, k), (None,))[:2] == o[:2]] if o and o[0] == r else [c]
            parts.append((o[3] if o and o[0] == r else "").ljust(sum(width.get(k, 0) for k in wide) + 3 * (len(wide) - 1)))
            c += len(wide)
        lines.append(" | ".join(parts).rstrip())
    return lines


def grow(rng, depth=0):
    """A random tree of blocks and its page."""
    word = lambda: rng.choice(["alpha", "be", "gamma" * rng.choice([1, 20]), "x", "longer-word"])
    blocks, page = [], []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["p", "div", "gone", "unseen", "seen", "details", "svg", "table"] if depth < 3 else ["p", "table", "svg"])
        if kind == "p":
            words = [word() for _ in range(rng.randrange(1, 5))]
            blocks.append(("p", words))
            page.append("<p>" + rng.choice([" ", "\n "]).join(words) + rng.choice(["", "</p>"]))
        elif kind == "svg":
            words = [word() for _ in range(rng.randrange(3))]
            blocks.append(("svg", words))
            if page and page[-1].startswith("<p>") and not page[-1].endswith("</p>"):
                page.append("</p>")  # a drawing does not close a paragraph
            page.append("<svg><title>no</title>no" + "".join(f"<g><text x=1>{w[: len(w) // 2]}<tspan>{w[len(w) // 2 :]}</tspan></text></g>" for w in words) + "</svg>")
        elif kind == "table":
            n = rng.randrange(2, 5)
            rows, free = [[(1, 1, word()) for _ in range(n)]], [0] * n
            for r in range(1, rng.randrange(1, 6)):
                row, c = [], 0
                while c < n:
                    if free[c] > r:
                        c += 1
                        continue
                    across = 1
                    while across < 3 and c + across < n and free[c + across] <= r and rng.random() < 0.3:
                        across += 1
                    down = rng.choice([1, 1, 1, 2, 3])
                    free[c : c + across] = [r + down] * across
                    row.append((across, down, word()))
                    c += across
                    if rng.random() < 0.1:
                        break
                rows.append(row)
            blocks.append(("table", rows))
            page.append("<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan='{d}'>{w}" + rng.choice(["", "</td>"]) for a, d, w in row) for row in rows) + "</table>")
        else:
            inner, text = grow(rng, depth + 1)
            if kind == "details":
                is_open, words = rng.random() < 0.5, [word()]
                blocks.append(("details", is_open, words, inner))
                page.append(f"<details{' open' if is_open else ''}><summary>{' '.join(words)}</summary>{text}</details>")
                continue
            blocks.append((kind, inner))
            begin = {"div": "<div>", "gone": rng.choice(["<div hidden>", "<dialog>", "<div style='color:red; display : none'>"]), "unseen": "<div style='visibility: hidden'>", "seen": "<div style='Visibility:visible'>"}[kind]
            page.append(f"{begin}{text}</{begin[1:].split('>')[0].split(' ')[0]}>")
    return blocks, "".join(page)


def test_layout_equals_a_naive_one_over_random_trees():
    rng = random.Random(12)
    for _ in range(600):
        blocks, page = grow(rng)
        lines, gap = [], False
        for spaced, own in naive(blocks, True):
            gap = gap or spaced and bool(lines)
            if own:
                lines += [""] * (gap and bool(lines)) + own
                gap = spaced
        assert text(page) == "\n".join(lines).strip("\n"), page


def test_spans_visibility_and_drawings():
    page = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td colspan=2>over two<td>f<tr><td>g<td colspan=900>h</table>"
    assert text(page).split("\n") == ["a | b    | c", "  | d    | e", "over two | f", "g | h"]
    assert text("<table><tr><td>" + "w" * 61 + "<td>x<tr><td>a<td>y</table>").split("\n")[1] == "a" + " " * 60 + " | y"
    assert render(build_tree("<table><tr><td>" + "w" * 61 + "<td>x<tr><td>a<td>y</table>"), 60).split("\n")[1] == "a | y"
    assert text("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>") == "yes"
    assert text("a<svg><desc>no</desc><text>b</text><g><text>c</text></g></svg>d") == "a\nb\nc\nd"
    assert text("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"
    assert text("<details>no<summary>s</summary><p>no</details><details open><summary>t</summary>u</details>") == "s\nt\nu"
    assert text("<ul><li style='visibility:hidden'>no<li>b</ul>") == "- b"
    assert text("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>").split("\n") == ["a | b", "  | c", "  | d"]


def test_carried_columns_may_not_clash(spark):
    df = spark.createDataFrame([(1, "<p>a", 5)], "page_id long, html string, n_chars int")
    assert extract_text(df).collect()[0]["n_chars"] == 1
    try:
        extract_text(df, carry=["page_id", "n_chars"])
    except ValueError as e:
        assert "clash" in str(e)
    else:
        raise AssertionError
