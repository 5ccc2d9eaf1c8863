"""Trains the block labeller on made-up pages: ``python -m lodestone.llm.html_train``.

Pages mix the ways in which sites mark their parts (elements, classes, ids, roles, or nothing
but the blocks' shape); each block of a page is known to be main text or not.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from lodestone.llm import html_extract as hx

MARK = "\ue000"
_SYLLABLES = "th er an in on re ti es or at ed is it al ar st nd to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur é ö ü ñ ción sch eau".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def sentence(r: random.Random, low: int = 4, high: int = 18) -> str:
    s = " ".join(word(r) for _ in range(r.randint(low, high)))
    kind = r.random()
    if kind < 0.05:
        return s.upper().replace(" ", "!! ") + "!!"
    if kind < 0.1:
        return " ".join(w + r.choice(["***", "%%%", "$$$", "###", "&amp;&amp;&amp;"]) for w in s.split())
    if kind < 0.13:
        return s.replace(" ", " | ")
    return s.capitalize() + r.choice([".", ".", ".", "!", "?", ""])


def paragraph(r: random.Random) -> str:
    n = r.choice([1, 1, 1, 2, 3, 5, 8])
    s = " ".join(sentence(r) for _ in range(n))
    if r.random() < 0.25:
        a, b = s[: len(s) // 2].rpartition(" ")[::2]
        s = a + " <" + (t := r.choice(["b", "i", "em", "strong", "code"])) + ">" + b + s[len(s) // 2 :] + f"</{t}>"
    if r.random() < 0.2:
        s += f' <a href="/{word(r)}">{word(r)} {word(r)}</a> {sentence(r, 2, 6)}'
    return s


def titled(r: random.Random) -> str:
    return sentence(r, 1, 9).rstrip(".")


def links(r: random.Random, n: int, bare: bool = False) -> str:
    item = lambda: f'<a href="/{word(r)}">{" ".join(word(r) for _ in range(r.choice([1, 1, 1, 2, 3])))}</a>'
    if bare:
        return r.choice([" | ", " ", " &middot; "]).join(item() for _ in range(n))
    return "<ul>" + "".join(f"<li>{item()}" + r.choice(["</li>", "</li>", ""]) for _ in range(n)) + "</ul>"


def box(r: random.Random, tags: list[str], names: list[str], inner: str) -> str:
    """An element named by its tag, a class, an id or a role."""
    tag = r.choice(tags)
    if tag in ("div", "section", "ul", "p", "span") or r.random() < 0.3:
        name = r.choice(names)
        name = r.choice([name, f"{word(r)}-{name}", f"{name}-{r.choice(['wrap', 'box', 'inner', 'block', 'area', '1'])}", f"{word(r)} {name}"])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'
    return f"<{tag}>{inner}</{tag}>"


def main_part(r: random.Random) -> str:
    m = MARK
    out = []
    if r.random() < 0.8:
        out.append(f"<h1>{m}{titled(r)}</h1>")
    for _ in range(r.choice([1, 1, 2, 3, 5, 8, 15, 30])):
        k = r.random()
        if k < 0.6:
            out.append(f"<p>{m}{paragraph(r)}" + r.choice(["</p>", "</p>", "</p>", "", "<br></p>"]))
        elif k < 0.72:
            out.append(f"<p><b>{m}{sentence(r)}<br>" + r.choice(["", "</b></p>"]))
        elif k < 0.8:
            h = r.choice(["h2", "h3", "h4"])
            out.append(f"<{h}>{m}{titled(r)}</{h}>")
        elif k < 0.87:
            t = r.choice(["ul", "ol"])
            out.append(f"<{t}>" + "".join(f"<li>{m}{sentence(r, 1, 12)}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 6))) + f"</{t}>")
        elif k < 0.91:
            out.append(f"<blockquote>{r.choice(['<p>', ''])}{m}{paragraph(r)}</blockquote>")
        elif k < 0.94:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{sentence(r, 1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif k < 0.96:
            out.append(f"<pre>{m}{sentence(r)}\n{sentence(r)}</pre>")
        elif k < 0.98:
            out.append(f"<figure><img src=x><figcaption>{m}{sentence(r)}</figcaption></figure>")
        else:
            out.append(f"<div>{m}{paragraph(r)}</div>")
        if r.random() < 0.04:
            out.append(junk(r, inside=True))
    body = "\n".join(out) if r.random() < 0.5 else "".join(out)
    k = r.random()
    if k < 0.45:
        body = f"<article>{body}</article>"
    elif k < 0.9:
        body = box(r, ["div", "div", "section", "main"], ["content", "article", "post", "entry", "main", "story", "body", "text", "article-body"], body)
    if r.random() < 0.25:
        body = f"<main>{body}</main>"
    return body


def junk(r: random.Random, inside: bool = False) -> str:
    kinds = ["ad", "share", "newsletter", "related"] if inside else ["ad", "ad", "share", "newsletter", "related", "sidebar", "sidebar", "cookie", "comments", "comments", "form", "breadcrumb", "notice", "menu", "login", "author"]
    k = r.choice(kinds)
    say = lambda: r.choice([sentence(r), paragraph(r), titled(r)])
    if k == "ad":
        return box(r, ["div", "div", "aside"], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "promotion"], r.choice([say(), f"<p>{say()}</p>", f'<a href="/x">{say()}</a>']))
    if k == "share":
        return box(r, ["div", "ul"], ["share", "social", "sharing", "tools"], links(r, 3, bare=True))
    if k == "newsletter":
        return box(r, ["div", "section", "form"], ["newsletter", "subscribe", "signup", "subscription"], f"<h3>{r.choice(['Subscribe', 'Newsletter', titled(r)])}</h3><p>{say()}</p><form><label>Email</label><input><button>{word(r)}</button></form>")
    if k == "related":
        return box(r, ["div", "section", "aside"], ["related", "recommended", "more", "popular", "trending", "read-more"], f"<h3>{titled(r)}</h3>" + links(r, r.randint(2, 6)))
    if k == "sidebar":
        return box(r, ["aside", "aside", "div"], ["sidebar", "side", "widget", "rail", "aside"], f"<h3>{titled(r)}</h3>" + r.choice([f"<p>{say()}</p>" * r.randint(1, 3), links(r, 5), say()]))
    if k in ("cookie", "notice"):
        return box(r, ["div", "div", "section"], ["cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "cookie-banner", "banner"], r.choice([f"<p>{say()}</p>", say()]) + r.choice(["", f"<button>{r.choice(['Accept', 'OK', word(r)])}</button>"]))
    if k == "comments":
        one = lambda: box(r, ["div", "li", "article"], ["comment", "reply", "comment-body", "response"], r.choice([f"<p>{paragraph(r)}</p>", f"<span>{word(r)}</span><p>{paragraph(r)}</p>", paragraph(r)]))
        return box(r, ["section", "div", "ol", "ul"], ["comments", "discussion", "responses", "disqus", "comment-list", "respond"], r.choice(["", f"<h2>{r.choice(['Comments', titled(r)])}</h2>"]) + "".join(one() for _ in range(r.randint(1, 5))))
    if k in ("form", "login"):
        return f"<form {r.choice(['', 'class=\"search\"', 'id=\"login\"', 'action=\"/go\"'])}>" + r.choice(["<label>", "<p>", ""]) + say() + f"<input name=q><button>{word(r)}</button></form>"
    if k == "breadcrumb":
        return box(r, ["div", "nav", "ol"], ["breadcrumb", "breadcrumbs", "crumbs", "path"], links(r, 3, bare=True))
    if k == "author":
        return box(r, ["div"], ["author-bio", "byline", "tags", "meta-info"], links(r, 2, bare=True))
    return box(r, ["nav", "nav", "div"], ["menu", "nav", "navigation", "navbar", "topnav"], links(r, r.randint(2, 8), bare=r.random() < 0.3))


def page(r: random.Random) -> str:
    """A page whose main blocks begin with ``MARK``."""
    top, bottom = [], []
    if r.random() < 0.5:
        top.append(box(r, ["header", "header", "div"], ["header", "masthead", "top", "site-header", "logo"], r.choice([titled(r), f"<h1>{titled(r)}</h1>", f"<p>{sentence(r)}</p>", f'<a href="/">{word(r)}</a>'])))
    if r.random() < 0.8:
        top.append(box(r, ["nav", "nav", "nav", "div", "ul"], ["nav", "menu", "navigation", "navbar", "main-menu"], links(r, r.randint(2, 10), bare=r.random() < 0.2)))
    for where in (top, bottom):
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            where.append(junk(r))
    r.shuffle(top)
    if r.random() < 0.85:
        bottom.append(box(r, ["footer", "footer", "footer", "div"], ["footer", "foot", "copyright", "site-footer", "bottom"], r.choice([f"&copy; {word(r)}.example.com &middot; {sentence(r)}", f"<p>&copy; {word(r)} {sentence(r)}</p>", links(r, 4), f"&copy; {r.randint(1999, 2026)} {word(r)}.\n{sentence(r)}", paragraph(r)])))
    head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{titled(r)}</title><style>p{{margin:0}}</style></head><body>'
    return head + "".join(top) + main_part(r) + "".join(bottom) + r.choice(["</body></html>", ""])


def examples(r: random.Random, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for _ in range(n):
        cut = hx.blocks_of(page(r))
        if cut:
            y = np.array([MARK in t for t, _, _ in cut], np.float32)
            out.append((hx.vectors([(t.replace(MARK, "").strip() or "x", p, k) for t, p, k in cut]), y))
    return out


def _lstm_with_grads(x, mask, w, u, b):
    """Forward pass that keeps what the backward pass needs, and that pass."""
    n, h_dim = hx.HIDDEN, hx.HIDDEN
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
    kept, out = [], np.empty((steps, pages, n), np.float32)
    for t in range(steps):
        a = x[t] @ w + h @ u + b
        i, f, o, g = hx.sigmoid(a[:, :n]), hx.sigmoid(a[:, n : 2 * n]), hx.sigmoid(a[:, 2 * n : 3 * n]), np.tanh(a[:, 3 * n :])
        m = mask[t][:, None]
        c2 = m * (f * c + i * g) + (1 - m) * c
        tc_ = np.tanh(c2)
        h2 = m * (o * tc_) + (1 - m) * h
        kept.append((h, c, i, f, o, g, tc_, m))
        h, c = h2, c2
        out[t] = h

    def back(d_out):
        dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros_like(b)
        dh, dc = np.zeros((pages, h_dim), np.float32), np.zeros((pages, h_dim), np.float32)
        for t in range(steps - 1, -1, -1):
            h0, c0, i, f, o, g, tc_, m = kept[t]
            dh = dh + d_out[t]
            dm = dh * m
            do, dcm = dm * tc_, dm * o * (1 - tc_**2) + dc * m
            da = np.concatenate([dcm * g * i * (1 - i), dcm * c0 * f * (1 - f), do * o * (1 - o), dcm * i * (1 - g**2)], 1)
            dw += x[t].T @ da
            du += h0.T @ da
            db += da.sum(0)
            dh = da @ u.T + dh * (1 - m)
            dc = dcm * f + dc * (1 - m)
        return dw, du, db

    return out, back


def train(seed: int = 7, rounds: int = 600, batch: int = 64) -> dict[str, np.ndarray]:
    r, rng = random.Random(seed), np.random.default_rng(seed)
    d, n = hx.DIMS, hx.HIDDEN
    p = {}
    for k in "fb":
        p[f"w{k}"] = rng.normal(0, d**-0.5, (d, 4 * n)).astype(np.float32)
        p[f"u{k}"] = rng.normal(0, n**-0.5, (n, 4 * n)).astype(np.float32)
        bias = np.zeros(4 * n, np.float32)
        bias[n : 2 * n] = 1
        p[f"b{k}"] = bias
        p[f"v{k}"] = rng.normal(0, n**-0.5, n).astype(np.float32)
    p["vx"], p["c"] = np.zeros(d, np.float32), np.zeros(1, np.float32)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, rounds + 1):
        data = examples(r, batch)
        sizes = np.array([len(y) for _, y in data])
        steps = int(sizes.max())
        x, y = np.zeros((steps, len(data), d), np.float32), np.zeros((steps, len(data)), np.float32)
        for k, (a, b) in enumerate(data):
            x[: len(b), k], y[: len(b), k] = a, b
        mask = (np.arange(steps)[:, None] < sizes).astype(np.float32)
        fore, back_f = _lstm_with_grads(x, mask, p["wf"], p["uf"], p["bf"])
        rear, back_b = _lstm_with_grads(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"])
        rear = rear[::-1]
        s = fore @ p["vf"] + rear @ p["vb"] + x @ p["vx"] + p["c"]
        e = (hx.sigmoid(s) - y) * mask / mask.sum()
        g = {"vf": np.einsum("tp,tph->h", e, fore), "vb": np.einsum("tp,tph->h", e, rear), "vx": np.einsum("tp,tpd->d", e, x), "c": np.array([e.sum()])}
        g["wf"], g["uf"], g["bf"] = back_f(e[..., None] * p["vf"])
        g["wb"], g["ub"], g["bb"] = back_b((e[..., None] * p["vb"])[::-1])
        rate = 0.01 * min(1, step / 20) * (0.1 ** (step / rounds))
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if step % 50 == 0:
            print(step, "right", round(float((((s > 0) == y) * mask).sum() / mask.sum()), 4), flush=True)
    return p


if __name__ == "__main__":
    weights = train()
    np.savez_compressed(Path(hx.__file__).with_name("html_model.npz"), **weights)
    held = examples(random.Random(99), 500)
    got = hx.main_blocks([a for a, _ in held], weights)
    right = sum(int((g == (y > 0)).sum()) for g, (_, y) in zip(got, held))
    print("held-out blocks right", right / sum(len(y) for _, y in held), "pages all right", np.mean([bool((g == (y > 0)).all()) for g, (_, y) in zip(got, held)]))
