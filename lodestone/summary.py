"""What a run says at its end: a boxed summary, statistics as JSON, and outputs for continuous integration."""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

from lodestone.operators.stats import first_names

REASONS = {"not-included": "not in the include list", "too-large": "too large"}


def number(n: float) -> str:
    return f"{round(n):,}"


def percent(ratio: float) -> str:
    p = ratio * 100
    return f"{p:.1f}%" if 0 < p < 10 else f"{p:.0f}%"


def short(n: int) -> str:
    """950, 1.2k, 12k, 1.2M."""
    if n < 1000:
        return str(n)
    return (f"{n / 1000:.1f}k" if n < 10_000 else f"{n / 1000:.0f}k") if n < 1_000_000 else f"{n / 1_000_000:.1f}M"


def colored(text: str, code: int, on: bool) -> str:
    return f"\x1b[{code}m{text}\x1b[0m" if on and text else text


def wants_color(stream=sys.stdout) -> bool:
    return "NO_COLOR" not in os.environ and ("FORCE_COLOR" in os.environ or getattr(stream, "isatty", lambda: False)())


def table(rows: list[list[str]], right: tuple[int, ...] = (), head: list[str] | None = None) -> str:
    """Rows in a box; ``right``: columns that end at their edge."""
    every = [*([head] if head else []), *rows]
    widths = [max(len(r[k]) for r in every) for k in range(len(every[0]))]
    line = lambda r: "│ " + " │ ".join(x.rjust(w) if k in right else x.ljust(w) for k, (x, w) in enumerate(zip(r, widths))) + " │"
    rule = lambda a, b, c: a + b.join("─" * (w + 2) for w in widths) + c
    out = [rule("┌", "┬", "┐"), *([line(head), rule("├", "┼", "┤")] if head else []), *map(line, rows), rule("└", "┴", "┘")]
    return "\n".join(out)


def summary(stats: dict, where: str, mode: str, top: int = 10, budget=None, parts: list[int] | None = None, hits: list[tuple[str, list[str]]] | None = None, color: bool = False) -> str:
    """The summary of :func:`lodestone.api.statistics` and of what else was done."""
    f, t = stats["files"], stats["tokens"]
    rows = [["Mode", mode], ["Files scanned", number(f["scanned"])], ["Files included", f"{number(f['included'])}  ({', '.join(f'{n} {k}' for k, n in sorted(f['byStrategy'].items()))})"]]
    rows.append(["Skipped", f"{number(sum(f['skipped'].values()))}" + (f"  ({', '.join(f'{n} {REASONS.get(k, k)}' for k, n in sorted(f['skipped'].items()))})" if f["skipped"] else "")])
    rows += [[label, number(stats[k])] for label, k in (("Bodies stripped", "strippedBodies"), ("Comments stripped", "strippedComments")) if stats[k]]
    rows.append(["Tokens", f"{number(t['output'])}  of {number(t['baseline'])} raw"])
    if t["baseline"] > t["output"]:
        rows.append(["Tokens saved", percent(stats["savedRatio"])])
    if budget is not None:
        moved = [r["now"] for r in budget.changes.collect()]
        gone = moved.count("omitted")
        said = ", ".join(x for x in (f"{len(moved) - gone} compressed" if len(moved) > gone else "", f"{gone} omitted" if gone else "") if x)
        rows.append(["Token budget", f"{number(budget.tokens)} / {number(budget.limit)} {'fits' if budget.fits else 'over'}" + (f"  ({said})" if said else "")])
    if parts and len(parts) > 1:
        rows.append(["Parts", f"{len(parts)}  ({' / '.join(map(number, parts))} tokens)"])
    out = [colored("lodestone summary", 1, color), table(rows)]
    if stats["costs"]:
        out += ["", table([[c["label"] + ("" if c["exact"] else "*"), number(c["tokens"]), f"${c['usd']:.4f}", f"${c['rawUsd']:.4f}"] for c in stats["costs"]], (1, 2, 3), ["Model", "Input tokens", "Cost", "Raw cost"])]
        if not all(c["exact"] for c in stats["costs"]):
            out.append("* estimated")
    if hits is not None:
        out += ["", table([[p, ", ".join(w)] for p, w in hits], (), ["Query matches", "Words"]) if hits else colored("No file matches the query.", 33, color)]
    if top and stats["filesByTokens"]:
        mark = lambda r: " [related]" if r["related"] else " [match]" if r["matched"] else " [focus]" if r["focused"] else ""
        listed = stats["filesByTokens"][:top]
        out += ["", table([[r["path"] + mark(r), number(r["tokens"]), percent(1 - r["tokens"] / r["raw"]) if r["raw"] > r["tokens"] else "-"] for r in listed], (1, 2), [f"Top {len(listed)} files", "Tokens", "Saved"])]
    if stats["redacted"]:
        n = sum(x["count"] for x in stats["redacted"])
        out += ["", colored(f"Masked {n} likely secret{'' if n == 1 else 's'} in {first_names([x['path'] for x in stats['redacted']])}.", 33, color)]
    if stats["parseErrors"]:
        out += ["", colored(f"Not parsed as a whole: {first_names(stats['parseErrors'])}.", 33, color)]
    return "\n".join([*out, "", where])


def stats_json(stats: dict, budget=None, parts: list[int] | None = None) -> str:
    """The statistics for other programs; what a run didn't do is left out."""
    more = {}
    if budget is not None:
        more["budget"] = {"maxTokens": budget.limit, "tokens": budget.tokens, "fits": budget.fits, "changes": [{"path": r["path"], "from": r["was"], "to": r["now"]} for r in budget.changes.orderBy("path").collect()]}
    if parts:
        more["parts"] = parts
    files = [{k: v for k, v in f.items() if v not in (None, False)} for f in stats["filesByTokens"]]
    return json.dumps({**stats, **more, "filesByTokens": files}, indent=2, ensure_ascii=False, default=str)


def report(stats: dict, written: list[str], outputs: str | None = None, step_summary: str | None = None) -> str:
    """Append outputs (name=value) and a Markdown summary to the files that a CI runner names; one line about the run."""
    saved = round(stats["savedRatio"] * 100)
    t = stats["tokens"]
    if outputs:
        pairs = {"output-path": written[0] if written else "", "files": stats["files"]["included"], "tokens": t["output"], "raw-tokens": t["baseline"], "saved-percent": saved}
        with open(outputs, "a", encoding="utf-8") as f:
            f.writelines(f"{k}={v}\n" for k, v in pairs.items())
            f.write("output-paths<<END_OF_PATHS\n" + "\n".join(written) + "\nEND_OF_PATHS\n")
    if step_summary:
        lines = ["### Packed code", "", "| | |", "| --- | --- |", f"| Files | {number(stats['files']['included'])} of {number(stats['files']['scanned'])} |", f"| Tokens | **{number(t['output'])}** (raw {number(t['baseline'])}, saved {saved}%) |"]
        lines += [f"| {c['model']} input | ${c['usd']:.4f} |" for c in stats["costs"]]
        lines += ["", "<details><summary>Largest files</summary>", "", "| File | Tokens | Raw |", "| --- | ---: | ---: |", *[f"| `{r['path']}` | {number(r['tokens'])} | {number(r['raw'])} |" for r in stats["filesByTokens"][:10]], "", "</details>", ""]
        with open(step_summary, "a", encoding="utf-8") as f:
            f.write("\n".join(lines))
    return f"{number(t['output'])} tokens ({saved}% saved) → {', '.join(written) or 'nothing written'}"


def tree_lines(rows: list[dict], depth: int, least: float) -> list[str]:
    """Lines of :func:`lodestone.operators.stats.folder_lines`: what each folder holds, its largest entries first."""
    below: dict[str, list[dict]] = {}
    for r in rows:
        below.setdefault(r["dir"], []).append(r)
    total = sum(r["tokens"] for r in below.get(".", [])) or 1
    out: list[str] = []

    def visit(folder: str, lead: str, level: int) -> None:
        own = sorted(below.get(folder, []), key=lambda r: r["place"])
        for k, r in enumerate(own):
            last = k == len(own) - 1
            if r["name"] is None:
                out.append(f"{lead}└── … {r['files']} more under {percent(least)} each")
                continue
            saved = f" −{percent(1 - r['tokens'] / r['raw'])}" if r["raw"] > r["tokens"] else ""
            n = "" if r["is_file"] else f" ({r['files']} file{'' if r['files'] == 1 else 's'})"
            out.append(f"{lead}{'└── ' if last else '├── '}{r['name']}{'' if r['is_file'] else '/'} {short(r['tokens'])} {percent(r['tokens'] / total)}{saved}{n}")
            if not r["is_file"] and level < depth:
                visit(r["name"] if folder == "." else f"{folder}/{r['name']}", f"{lead}{'    ' if last else '│   '}", level + 1)

    visit(".", "", 1)
    return out


def part_file(path: str, index: int) -> str:
    """out.md to out.part2.md, for one path."""
    p = Path(path)
    dot = p.name.rfind(".")
    return str(p.with_name(f"{p.name[:dot]}.part{index}{p.name[dot:]}" if dot > 0 else f"{p.name}.part{index}"))
