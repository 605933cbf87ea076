"""python -m lodestrand COMMAND: verify, query, show, walk, validate, account, successor, lock. COMMAND --help tells its arguments."""

from __future__ import annotations

import argparse
import json
import sys


def _show(value: object) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False))


def _read(path: str | None) -> str:
    if path is None:
        return sys.stdin.read()
    with open(path, encoding="utf-8") as f:
        return f.read()


def _opened(spark, args):  # noqa: ANN001, ANN202
    from lodestrand.plans import release

    return release.verify(spark, args.package)


def verify(spark, args) -> int:  # noqa: ANN001
    _show(_opened(spark, args).report)
    return 0


def query(spark, args) -> int:  # noqa: ANN001
    from lodestrand.plans import adapters, core

    result = core.QueryCore(_opened(spark, args)).execute(_read(args.request))
    _show(result if args.command == "query" else adapters.Presenter().present_result(result))
    return int(result["outcome"] != "success")


def walk(spark, args) -> int:  # noqa: ANN001
    """All pages of a request, held against the oracle if asked for."""
    from lodestrand.plans import core, evidence

    payload = json.loads(_read(args.request))
    rows = core.walk(core.QueryCore(_opened(spark, args)), payload)
    wrong = evidence.Oracle(args.package).differs(payload["similarity"]["query_record_id"], rows) if args.oracle else []
    _show({"rows": rows, "differs": wrong})
    return int(bool(wrong))


def validate(spark, args) -> int:  # noqa: ANN001
    from lodestrand.plans import evidence

    evidence.write_validation(_opened(spark, args).report, args.bundle, args.run, args.bundle_id, args.environment_label, args.package)
    return 0


def account(spark, args) -> int:  # noqa: ANN001
    """Archives against a source inventory: the stage envelope, and the accessions that are there."""
    from lodestrand.plans import builder
    from lodestrand.sources import files

    expected = files.load_inventory(spark, json.loads(_read(args.inventory)))
    found = builder.account_archives(files.read_members(spark, args.archives, args.suffix), expected)
    envelope = builder.stage_envelope("account", found)
    files.write_document(envelope, args.out)
    return int(envelope["outcome"] != "succeeded")


def successor(spark, args) -> int:  # noqa: ANN001
    from lodestrand.plans import builder

    handle = builder.succeed(spark, args.package, args.out, args.release_id, args.path, json.loads(_read(args.document)))
    _show(handle.report)
    return 0


def lock(spark, args) -> int:  # noqa: ANN001
    from lodestrand.plans import evidence

    _show(evidence.environment_lock(args.out) | ({"commit": evidence.pinned_commit(args.root)} if args.root else {}))
    return 0


COMMANDS = {
    "verify": (verify, ["package"]),
    "query": (query, ["package", "request?"]),
    "show": (query, ["package", "request?"]),
    "walk": (walk, ["package", "request?", "--oracle!"]),
    "validate": (validate, ["package", "bundle", "run", "--bundle-id", "--environment-label"]),
    "account": (account, ["archives", "inventory", "out", "--suffix"]),
    "successor": (successor, ["package", "out", "release_id", "path", "document"]),
    "lock": (lock, ["out", "root?"]),
}


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="lodestrand", description=__doc__)
    commands = own.add_subparsers(dest="command", required=True)
    for name, (_, wanted) in COMMANDS.items():
        part = commands.add_parser(name)
        for arg in wanted:
            if arg.endswith("!"):
                part.add_argument(arg[:-1], action="store_true")
            elif arg.startswith("--"):
                part.add_argument(arg, default="" if arg == "--suffix" else None, required=arg != "--suffix")
            else:
                part.add_argument(arg.rstrip("?"), nargs="?" if arg.endswith("?") else None)
    return own


def main(args: list[str]) -> int:
    from lodestrand.plans.release import ReleaseRefused
    from lodestrand.session import build_session

    try:
        known = parser().parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    run = COMMANDS[known.command][0]
    try:
        return run(build_session() if known.command != "lock" else None, known)
    except ReleaseRefused as e:
        _show({"code": e.code, "message": e.message})
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
