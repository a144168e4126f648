"""Command line: ``profile``, ``schema`` and ``diff``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from rowscope.operators import diff as diffs
from rowscope.operators import schema
from rowscope.operators.profile import Profile, as_dict, profile
from rowscope.operators.sinks import replacing
from rowscope.session import session
from rowscope.sources.detect import spool
from rowscope.sources.readers import open_source


def table(p: Profile) -> str:
    """FIELD PRESENCE TYPES NULL DISTINCT DRIFT; ~ marks approximate counts."""
    rows = [("FIELD", "PRESENCE", "TYPES", "NULL", "DISTINCT", "DRIFT")]
    for f in p.fields:
        kinds = ",".join(f"{k}:{100 * s:.0f}%" for k, s in sorted(f.shares.items(), key=lambda x: (-x[1], x[0])))
        rows.append((f.path, f"{100 * f.presence_rate:.1f}%", kinds, f"{100 * f.null_rate:.1f}%", ("" if f.exact else "~") + str(f.distinct), "yes" if f.drift else ""))
    width = [max(len(r[i]) for r in rows) for i in range(6)]
    head = f"{p.records} records, {p.skipped} skipped\n"
    return head + "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in rows) + "\n"


def main(args: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="rowscope")
    sub = ap.add_subparsers(dest="command", required=True)

    def command(name: str, *files: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for f in files:
            p.add_argument(f)
        p.add_argument("--format")
        p.add_argument("--csv-raw", action="store_true")
        p.add_argument("--table")
        return p

    command("profile", "file").add_argument("--json", action="store_true")
    command("schema", "file").add_argument("-o", "--output")
    p = command("diff", "old", "new")
    p.add_argument("--json", action="store_true")
    p.add_argument("--fail-on", choices=("breaking", "any", "none"), default="breaking")
    try:
        a = ap.parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = session()

    def load(path: str) -> Profile:
        temp = spool(sys.stdin.buffer) if path == "-" else None
        try:
            if not temp and "://" not in path and not os.path.exists(path):
                raise FileNotFoundError(path)
            return profile(open_source(spark, temp or path, a.format, a.csv_raw, a.table))
        finally:
            if temp:
                os.unlink(temp)

    try:
        if a.command == "profile":
            got = load(a.file)
            sys.stdout.write(json.dumps(as_dict(got), indent=2, ensure_ascii=False) + "\n" if a.json else table(got))
        elif a.command == "schema":
            text = schema.text(load(a.file))
            if a.output:
                with replacing(a.output) as f:
                    f.write(text.encode())
            else:
                sys.stdout.write(text)
        else:
            d = diffs.diff(load(a.old), load(a.new))
            sys.stdout.write(diffs.render(d, a.json))
            return diffs.gate(d, a.fail_on)
    except Exception as e:
        sys.stderr.write(f"rowscope: {e}\n")
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
