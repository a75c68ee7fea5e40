"""A small script runner over a repository: one verb a line, # comments, -F for a line that must fail, stop at the first error.

Keys: put KEY VALUE | get KEY | branch KEY OLD NEW | rename KEY OLD NEW | delete-branch KEY NAME | merge KEY TARGET REF VALUE |
latest KEY | list-keys | list-branches KEY | meta KEY VERSION | exists KEY | head KEY | is-head KEY BRANCH VERSION |
is-latest KEY VERSION | history KEY VERSION | info.
Tables: load-csv TABLE PATH | dump-csv TABLE PATH | branch-table TABLE NEW | list-table-branch TABLE | exists-table TABLE |
exists-column TABLE COLUMN | get-column TABLE COLUMN | get-row TABLE COLUMN VALUE | insert-row TABLE COLUMN=VALUE... |
update-row TABLE COLUMN VALUE COLUMN=VALUE... | delete-row TABLE COLUMN VALUE | delete-column TABLE COLUMN | delete-table TABLE |
diff-table TABLE OTHER-BRANCH.
Datasets: create-dataset NAME | list-dataset | load-dataset NAME PATH POSITIONS | get-dataset NAME | export-dataset NAME PATH | branch-dataset NAME NEW |
list-dataset-branch NAME | exists-dataset NAME | delete-dataset NAME | put-entry NAME ENTRY VALUE | get-entry NAME ENTRY |
exists-entry NAME ENTRY | delete-entry NAME ENTRY | list-entry-branch NAME ENTRY | diff-dataset NAME OTHER-BRANCH | search NAME QUERY.

-b BRANCH is the branch worked on, master without. `@n` stands for the n-th latest version made. Each verb that works goes to the
repository's access log when the script ends.
"""

from __future__ import annotations

from strata.errors import Code, StrataError
from strata.functions.text import tokenize_args
from strata.plans.repository import MASTER, Repository, VersionedDataset

MAKING = {"put", "merge", "load-csv", "insert-row", "update-row", "delete-row", "delete-column", "create-dataset", "put-entry", "delete-entry"}  # verbs that make a version

class Script:
    def __init__(self, repo: Repository):
        self.repo = repo
        self.made: list[str] = []
        self.log: list[tuple[str, str, str, str]] = []  # verb, key, branch, version: what goes to the access log

    def _word(self, w: str) -> str:
        if w[:1] == "@" and w[1:].isdigit():
            n = int(w[1:])
            if not 1 <= n <= len(self.made):
                raise StrataError(Code.VERSION_NOT_EXISTS, w)
            return self.made[-n]
        return w

    def run_line(self, line: str):
        words = tokenize_args(line)
        if words is None:
            raise StrataError(Code.QUERY_SYNTAX, line)
        words = [self._word(w) for w in words]
        verb, args, r = words[0], words[1:], self.repo
        branch = MASTER
        if "-b" in args:
            at = args.index("-b")
            branch, args = args[at + 1], args[:at] + args[at + 2 :]
        t = lambda name: r.table(name, branch)
        ds = lambda name: r.dataset(name, branch)
        pairs = lambda words: dict(w.split("=", 1) for w in words)
        one = lambda name, entry, value: ds(name).put(r.spark.createDataFrame([(entry, value)], "entry string, payload string"))
        verbs = {
            "put": lambda k, v: r.put(k, v, branch), "get": lambda k, v=None: r.get(k, branch, v), "branch": lambda k, old, new: r.branch(k, new, old=old), "rename": r.rename_branch,
            "delete-branch": r.delete_branch, "merge": lambda k, to, ref, v: r.merge(k, to, v, ref=ref), "latest": r.latest, "list-keys": r.list_keys, "list-branches": r.list_branches,
            "meta": r.commit, "exists": lambda k, b=None: r.exists(k, b), "head": lambda k, b=branch: r.head(k, b), "is-head": r.is_head, "is-latest": r.is_latest,
            "history": lambda k, v: [x["version"] for x in r.history(k, v).orderBy("distance", "version").collect()], "info": lambda: r.storage_info().collect(),
            "load-csv": lambda n, p: t(n).load_csv(p), "dump-csv": lambda n, p: t(n).dump_csv(p), "branch-table": lambda n, new: t(n).fork(new).name, "list-table-branch": lambda n: t(n).branches(),
            "exists-table": lambda n, b=None: t(n).exists(b), "exists-column": lambda n, c, b=None: t(n).exists_column(c, b), "get-column": lambda n, c: t(n).column(c), "get-row": lambda n, c, v: t(n).rows(c, v),
            "insert-row": lambda n, *w: t(n).insert(pairs(w)), "update-row": lambda n, c, v, *w: t(n).update(pairs(w), where=(c, v)), "delete-row": lambda n, c, v: t(n).delete(where=(c, v)),
            "delete-column": lambda n, c: t(n).drop_column(c), "delete-table": lambda n: t(n).drop(), "diff-table": lambda n, other: t(n).diff(other),
            "create-dataset": lambda n: ds(n).create(), "list-dataset": lambda: VersionedDataset.names(r), "load-dataset": lambda n, p, at: ds(n).load_csv(p, [int(x) for x in at.split(",")]), "get-dataset": lambda n: ds(n).read(),
            "export-dataset": lambda n, p: ds(n).export(p), "branch-dataset": lambda n, new: ds(n).fork(new).name, "list-dataset-branch": lambda n: ds(n).branches(), "exists-dataset": lambda n, b=None: ds(n).exists(b),
            "delete-dataset": lambda n: ds(n).drop(), "put-entry": one, "get-entry": lambda n, e: ds(n).get_entry(e)["payload"], "exists-entry": lambda n, e, b=None: ds(n).exists_entry(e, b),
            "delete-entry": lambda n, *e: ds(n).delete(*e), "list-entry-branch": lambda n, e: ds(n).entry_branches(e), "diff-dataset": lambda n, other: ds(n).diff(r.dataset(n, other)), "search": lambda n, q: ds(n).search(q),
        }
        if verb not in verbs:
            raise StrataError(Code.INVALID_PARAMETER, verb)
        try:
            out = verbs[verb](*args)
        except TypeError:
            raise StrataError(Code.INVALID_PARAMETER, line) from None
        made = out if verb in MAKING else ""
        if made:
            self.made.append(made)
        self.log.append((verb, args[0] if args else "", branch, made))
        return out

    def run(self, text: str) -> list:
        """Results of the lines; StrataError with the line's number at the first that doesn't go as it should."""
        try:
            return self._run(text)
        finally:
            self.repo.log(self.log)
            self.log = []

    def _run(self, text: str) -> list:
        out = []
        for n, line in enumerate(text.splitlines(), 1):
            line = line.split("#", 1)[0].strip()
            if line == "exit":
                break
            if not line:
                continue
            fail, line = line.startswith("-F "), line.removeprefix("-F ").strip()
            try:
                got = self.run_line(line)
            except StrataError as e:
                if not fail:
                    raise StrataError(e.code, f"line {n}: {line}") from None
                out.append(e.code)
                continue
            if fail:
                raise StrataError(Code.INVALID_PARAMETER, f"line {n} should fail: {line}")
            out.append(got)
        return out
