"""YAML documents, agent documents and late references on cases of their own."""

import json

from lodestack.operators import agents, clusters, references, yaml_docs


def files(spark, rows, kind=None):
    return spark.createDataFrame([(p, kind, c) for p, c in rows], "path string, file_type string, content string")


def test_yaml_documents(spark):
    body = "%YAML 1.1\n---\na: &x {b: 1, c: [[1, 2], [3]]}\nd: *x\n--- # second\n- 2026-01-02\n- .nan\n- yes\n---\n# nothing\n---\nbad: [1\n---\n1: one\nnull: none\n...\n--- text\n"
    bomb = "a: &a [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"{chr(98 + k)}: &{chr(98 + k)} [{', '.join(['*' + chr(97 + k)] * 10)}]\n" for k in range(8))
    rows = [("m.yaml", body), ("bomb.yml", bomb), ("tab.yaml", "a:\n\t- b"), ("none.yaml", None), ("empty.yaml", ""), ("crlf.yaml", "---\r\na: 1\r\n---\r\nb: 2\r\n")]
    got = {(r["path"], r["document"]): r for r in yaml_docs.yaml_documents(files(spark, rows)).collect()}
    assert {k: json.loads(r["json"]) for k, r in got.items() if r["json"]} == {("m.yaml", 0): {"a": {"b": 1, "c": [[1, 2], [3]]}, "d": {"b": 1, "c": [[1, 2], [3]]}}, ("m.yaml", 1): ["2026-01-02", None, True], ("m.yaml", 3): {"1": "one", "null": "none"}, ("m.yaml", 4): "text", ("crlf.yaml", 0): {"a": 1}, ("crlf.yaml", 1): {"b": 2}}
    assert {k for k, r in got.items() if r["error"]} == {("m.yaml", 2), ("bomb.yml", 0), ("tab.yaml", 0)}
    assert "more than" in got["bomb.yml", 0]["error"]


def test_manifests_are_workloads(spark):
    pod = "apiVersion: v1\nkind: Pod\nmetadata: {name: p, namespace: n}\nspec: {containers: [{name: c, image: nginx}]}\n"
    rows = [("a.yaml", pod + "---\nkind: NoVersion\n---\nnot: [closed\n"), ("l.yml", "apiVersion: v1\nkind: List\nitems:\n- " + pod.rstrip().replace("\n", "\n  ")), ("j.json", json.dumps({"apiVersion": "v1", "kind": "Pod", "metadata": {"name": "q"}, "spec": {"containers": [{"image": "x"}]}})), ("bad.json", "{"), ("other.txt", pod)]
    found = yaml_docs.manifest_resources(files(spark, rows))
    assert {(r["path"], r["document"], r["error"] is None) for r in found.collect()} == {("a.yaml", 0, True), ("a.yaml", 2, False), ("l.yml", 0, True), ("j.json", 0, True), ("bad.json", 0, False)}
    got = clusters.workloads(found.where("error is null").drop("error"))
    assert {(r["path"], r["namespace"], r["name"]) for r in got.collect()} == {("a.yaml", "n", "p"), ("l.yml", "n", "p"), ("j.json", "default", "q")}


def test_plugins(spark):
    listing = json.dumps({"plugins": [{"name": "a", "source": "./plugins/a"}, {"source": "https://h/x.git"}, {"source": {"url": "https://h/y", "sha": "f" * 40, "ref": "v1"}}, {"source": {"url": "https://h/z", "sha": "f", "ref": " Main "}}, {"source": {"url": "https://h/w", "sha": " "}}, {"source": {"deep": [{"source": "HTTP://h/deep"}]}}, {"source": "../out"}, {"source": {"path": "x"}}, {"source": 3}]}, indent=1)
    sources = agents.plugin_sources(files(spark, [("p/marketplace.json", listing), ("bad.json", '{"source"')], "agent_plugin"))
    got = {(r["rule"], r["dependency"], r["severity"], r["line_number"]) for r in agents.plugin_findings(sources).collect()}
    line = lambda url: next(k for k, s in enumerate(listing.split("\n"), 1) if url in s)
    assert got == {("plugin-source-unpinned", "https://h/x.git", "critical", line("x.git")), ("plugin-source-url", "https://h/y", "high", line("h/y")), ("plugin-source-moving-ref", "https://h/z", "medium", line("h/z")), ("plugin-source-unpinned", "https://h/w", "critical", line("h/w")), ("plugin-source-unpinned", "HTTP://h/deep", "critical", line("h/deep"))}
    held = agents.plugin_files(sources, files(spark, [("plugins/a/run.sh", "x"), ("plugins/a/b/c.py", "x"), ("plugins/ab/c.py", "x"), ("out/x", "x"), ("plugins/a", "x")]))
    assert {r["path"] for r in held.collect()} == {"plugins/a/run.sh", "plugins/a/b/c.py", "plugins/a"}


def test_skills(spark):
    text = "---\nname: s\nallowed-tools: Read, Bash(npx:*), Bash(uv)\nmetadata:\n  openclaw:\n    requires: {bins: [rg, 3, jq]}\n    install: {package: ' left-pad ', bins: lp}\n---\nbody Bash(no)\n"
    rows = [("a/SKILL.md", text), ("b/SKILL.md", "---\nallowed-tools: [Read, 'Bash(npm:install *)']\n---\n"), ("c/OTHER.md", text), ("d/SKILL.md", "---\n- list\n---\n"), ("e/SKILL.md", "---\na: [\n---\n"), ("f/SKILL.md", "no front"), ("g/SKILL.md", None)]
    got = sorted((r["path"], r["line_number"], r["rule"], r["dependency"]) for r in agents.skill_findings(files(spark, rows, "agent_instruction")).collect())
    assert got == sorted([("a/SKILL.md", 3, "skill-tool-runner", "npx"), ("a/SKILL.md", 3, "skill-tool-runner", "uv"), ("a/SKILL.md", 6, "skill-required-program", "rg"), ("a/SKILL.md", 6, "skill-required-program", "jq"), ("a/SKILL.md", 7, "skill-installed-package", "left-pad"), ("a/SKILL.md", 7, "skill-installed-program", "lp"), ("b/SKILL.md", 2, "skill-tool-runner", "npm")])


def test_fenced_blocks(spark):
    text = "pip install prose\n```bash\n$ pip install a\n# pip install comment\n```\n~~~~\n```\nnpm install -g b\n~~~~\n```python\npip install c\n```\n  ```sh\nnpm i -g d"
    blocks = agents.fenced_blocks(files(spark, [("x.md", text), ("none.md", "a `` b"), ("null.md", None)]))
    assert [(r["first_line"], r["language"], r["body"].count("\n")) for r in blocks.orderBy("first_line").collect()] == [(3, "bash", 1), (7, "", 1), (11, "python", 0), (14, "sh", 0)]
    got = agents.block_findings(files(spark, [("x.md", text)], "agent_instruction"))
    assert {(r["line_number"], r["rule"], r["dependency"]) for r in got.collect()} == {(3, "pip-install", "a"), (8, "npm-global", "b"), (14, "npm-global", "d")}


def test_late_references(spark):
    rows = [
        ("r", "ci.sh", "bash ./tools/run\nsh ../../etc/x && ./go; source lib/env.inc\ncat f --file conf/deps.txt"),
        ("r", "tools/run", "pip install late1"), ("r", "go", "pip install late2\nbash deep/next"), ("r", "lib/env.inc", "pip install late3"), ("r", "conf/deps.txt", "pip install late4"), ("r", "deep/next", "pip install never"), ("r", "etc/x", "npm i -g inside"), ("r", "unnamed", "pip install never"),
        ("q", "tools/run", "pip install other"), ("q", "a.sh", "bash a.sh\nbash missing\npip install first"),
    ]
    df = spark.createDataFrame([(*r, len(r[2])) for r in rows], "repository string, path string, content string, length long")
    got = {(r["repository"], r["path"], r["dependency"], r["late"]) for r in references.scan_repositories(df).where("category = 'unmanaged_package'").collect()}
    assert got == {("r", "tools/run", "late1", True), ("r", "go", "late2", True), ("r", "lib/env.inc", "late3", True), ("r", "conf/deps.txt", "late4", True), ("r", "etc/x", "inside", True), ("q", "a.sh", "first", False)}


def test_values_that_a_tag_does_not_fit_are_errors():
    for text in ("a: !!bool x", "a: !!timestamp x", "a: !!int ''"):
        json_text, error = yaml_docs.decode(text)
        assert json_text is None and error


def test_documents_decode_as_by_the_package():
    texts = ["1: a\n'1': b", "a: 0x1f\nb: 010\nc: 1_000\nd: 1:30\ne: -5\nf: 08\ng: 0", "a: yes\nb: TRUE\nc: true\nd: ~\ne:", "a: !!str 5\nb: !!int '7'\nc: ! 5", "<<: {a: 1}\nb: 2", "a: 1\nb: 2\na: 3", "? [a]\n: c", "!!set {a, b}", "a: 2001-01-01\nb: .inf\nc: 1e3", "&a [*a]", "a: &x {b: 1}\nc: *x"]
    for text in texts:
        try:
            expected = json.dumps(yaml_docs._plain(yaml_docs.yaml.load(text, yaml_docs.yaml.SafeLoader), [1000]), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, TypeError, RecursionError, yaml_docs.yaml.YAMLError):
            expected = None
        assert yaml_docs.decode(text)[0] == expected, text


def test_each_document_is_decoded_once(spark):
    pod = "apiVersion: v1\nkind: Pod\nmetadata: {name: p}\nspec: {containers: [{name: c, image: nginx}]}\n"
    found = yaml_docs.manifest_resources(files(spark, [("a.yaml", pod + "---\nnot: [closed\n")]))
    rows = clusters.workloads(found.select("path", "document", "error", "doc"), error="error")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("decode") == 0 and plan.count("MapInArrow") == 1 and plan.count("from_json(") == 1 + 3  # the text, and the items of lists in three depths
    assert {(r["document"], r["name"], r["error"] is None) for r in rows.collect()} == {(0, "p", True), (1, "", False)}


def test_documents_of_one_form_are_decoded_once(monkeypatch):
    """Documents that differ in plain values alone were all decoded by the package, which took most of the time."""
    made = []
    loaded = yaml_docs._loaded
    monkeypatch.setattr(yaml_docs, "_loaded", lambda text: made.append(text) or loaded(text))
    yaml_docs._forms.clear()
    for k in range(1, 200):
        assert yaml_docs.decode(f"kind: Pod\nmeta: &m\n  name: w{k}\n  n: {k}\nm: *m\n") == (f'{{"kind":"Pod","meta":{{"name":"w{k}","n":{k}}},"m":{{"name":"w{k}","n":{k}}}}}', None)
    assert len(made) == 1


def test_documents_by_form_are_those_of_the_package():
    """Values in texts, keys, comments, flow collections, beside tags and as equal keys give what the package alone gives."""
    frames = [
        "a: $1\nb: $2\na: $3", "a: |\n  k: $1\n  x\nb: >\n  k: $2\n  more\n\n  c: $1", "a: \"x\n  k: $1\n  y\"\nb: 'z\n  k: $2\n  y'", "{a: $1,\nb: $2\n, c: [1,\nd: $3\n]}", "a: $1\n  more\nb: $2\n  :30",
        "? \"q\n  k: $1\n  y\"\n: 1\n? \"q\n  k: $2\n  y\"\n: 2", "a: !!str\n  b: $1", "a: !!binary |\n  abcd: $1\n  efgh: $2", "- - a: $1\n    b: $2\n  - c: $1", "# k: $1\na: $1 # $2\nb: $2", "a: *$1\nb: &$1 2", "a: $1: $2", "k: $1\n k: $2", "zqjxv: $1\nb: zqjxv000\nc: $2", "a: 98765432109876000\nb: $1",
        "? a: $1\n: b", "a: &x\n  b: $1\nc:\n  <<: *x\n  b: $2", "!!set\na: $1", "a:\n- k: $1\n- k: $2\n- k: $3\n...", "a: 08\nb: $1", "a: \u2028k: $1\nb: $2\u2028c: $3", "a: $1\r\nb: $2\r\n", "a: $1\n\tb: $2", "[a: $1\n, b]", "a: 2001-01-01\nb: $1", "\u00e9: $1\nb: $2",
    ]
    for frame in frames:
        for values in (("w1", "x2", "w1"), ("1", "10", "1"), ("7", "n1", "7"), ("y1", "true1", "on0"), ("08", "1_0", "0x1"), ("yes", "null", "1e3"), ("999999999999999999", "e5", "1234567890123456789"), ("12", "12", "12")):
            text = frame
            for k, v in enumerate(values, 1):
                text = text.replace(f"${k}", v)
            try:
                expected = json.dumps(yaml_docs._plain(yaml_docs.yaml.load(text, yaml_docs._Loader), [1000]), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, TypeError, RecursionError, yaml_docs.yaml.YAMLError):
                expected = None
            for _ in range(2):
                assert yaml_docs.decode(text)[0] == expected, text


def test_many_values_and_forms_stay_right():
    text = "".join(f"k{k}: v{k}\n" for k in range(600)) + "".join(f"n{k}: {k + 1}\n" for k in range(600))
    for few in (text[:5000], text):
        assert json.loads(yaml_docs.decode(few)[0]) == yaml_docs.yaml.load(few, yaml_docs._Loader)
    for k in range(3 * yaml_docs._MOST_FORMS):
        assert yaml_docs.decode(f"a{k}: {k + 1}")[0] == f'{{"a{k}":{k + 1}}}'
    assert len(yaml_docs._forms) <= yaml_docs._MOST_FORMS


def test_pieces_and_resources_are_told_as_before(spark):
    """Which pieces hold a document, and which documents are resources, was told by other expressions."""
    from pyspark.sql import functions as F

    pieces = ["", " ", "\n# c\n%d\n", "\t# c\nx", "  %a\n \n", "a # b", "\u2028", "# a\u2028b", "# a\u0085# b", "#", "\r# a\r\n", "# a\rb", "\x0b# a", "\x0b", "# a\n\x0c \n# b", "\u00a0", "-", "# a\n  #b\n\t%c\n   d"]
    texts = ["kind: Pod\napiVersion: v1", "kind: Pod", "kind: PodList\nitems: []", "kind: PodList\nitems:", "kind: [List]\nitems: [1]", "kind: ''\napiVersion: ''", "kind: w1\napiVersion: w2", "kind: List\nitems: w1", "kind: w1\nitems: [x]", "- kind: a\n  apiVersion: b", "text", "12", "kind: 5\napiVersion: 6", "kind: !!null x\napiVersion: v1", "kind: .nan\napiVersion: v1", "kind: {a: List}\nitems: 1", "kind: {a: b}\napiVersion: [c]", "kind: false\napiVersion: false"]
    df = spark.createDataFrame([(f"{k:03}.yaml", p) for k, p in enumerate(pieces + texts)], "path string, content string")
    kept = df.where(~F.regexp_replace("content", r"(?m)^[ \t]*(?:#|%).*$", "").rlike(r"\A\s*\z"))
    assert sorted(r["path"] for r in yaml_docs.yaml_documents(df).collect()) == sorted(r["path"] for r in kept.collect())
    field = lambda n: F.get_json_object("json", f"$.{n}")
    listed = field("items").isNotNull() & F.coalesce(field("kind"), F.lit("")).endswith("List")
    want = yaml_docs.yaml_documents(df).where(F.col("error").isNotNull() | listed | field("kind").isNotNull() & field("apiVersion").isNotNull())
    found = yaml_docs.manifest_resources(df)
    assert sorted(r["path"] for r in found.collect()) == sorted(r["path"] for r in want.collect())
