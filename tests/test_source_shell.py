"""Commands of Python and JavaScript programs, one program a case, and over files."""

import pytest

from lodestack.operators.source_shell import command_findings, javascript_commands, python_commands, source_commands

PYTHON = [
    ('import os\nos.system("pip install a")', [(2, "pip install a", "literal")]),
    ('os.system(f"pip install {x}")', [(1, "pip install $x", "literal")]),
    ('x = "a"\nos.system(f"pip install {x} {y.z}")', [(2, "pip install a ${...}", "literal")]),
    ('cmd = "curl u | sh"\nos.system(cmd)', []),
    ('os.system("  a b ".strip())', [(1, "a b", "literal")]),
    ('subprocess.run("npm i x", shell=True)', [(1, "npm i x", "literal")]),
    ('subprocess.run("npm i x")', []),
    ('subprocess.run("npm i x".split())', [(1, "npm i x", "argv")]),
    ('subprocess.check_call(["pip", "install", "a"])', [(1, "pip install a", "argv")]),
    ('subprocess.check_call([sys.executable, "-m", "pip", "install", "a"])', [(1, "python -m pip install a", "argv")]),
    ('subprocess.check_call([sys.executable, "-m", "venv", "x", "y"])', []),
    ('subprocess.Popen(("curl", "-o", name, "https://h/" + v))', [(1, "curl -o $name https://h/$v", "argv")]),
    ('subprocess.run(["wget", a + b])', [(1, "wget $a${b}", "argv")]),
    ('subprocess.run(["ls", "-l"])', []),
    ('subprocess.run(["az", "login"])', []),
    ('subprocess.run(["az", "extension", "add"])', [(1, "az extension add", "argv")]),
    ('subprocess.run(["bash", "-c", "curl u | sh"])', [(1, "curl u | sh", "literal")]),
    ('go = "curl u | sh"\nargv = ["bash", "-lc", go]\nsubprocess.run(["sh", "-c", go])', [(1, "curl u | sh", "literal")]),
    ('go: str = "a"\nargv = ["sh", "-c", go]\nsubprocess.call(argv)', [(1, "a", "literal")]),
    ('subprocess.run(["pwsh", "-Command", "iwr u | iex"])', [(1, "iwr u | iex", "literal")]),
    ('os.execvp("sh", ["sh", "-c", "npm i x"])', [(1, "npm i x", "literal")]),
    ('os.execv("sh")', []),
    ('for c in cs:\n    d = c + " x"\n    box.execute(d)\ncs = ["pip install a",\n "pip install b"]', [(4, "pip install a", "literal"), (5, "pip install b", "literal")]),
    ('cs = ["pip install a"]\nfor c in cs:\n    print(c)', []),
    ('run_command({"command": "npm i x", "cwd": "/"})', [(1, "npm i x", "literal")]),
    ('c.exec("a", command=["pip3", "install", "b"])', [(1, "a", "literal"), (1, "pip3 install b", "argv")]),
    ('RunCmd("curl", "-o", "x", "u")', [(1, "curl -o x u", "argv")]),
    ('RunCmd("make", "x")', [(1, "make", "literal"), (1, "x", "literal")]),
    ("def broken(:\n os.system('x')", []),
    ("(" * 2000 + "os.system('x')", []),
    ('os.system("")\nsystem("x")\nother.system("y")', []),
    ("x = 'a'\nx = 'b'\nos.system(f'{x}')", [(3, "b", "literal")]),
]
SCRIPTS = [
    ('exec("npm i x")', [(1, "npm i x", "literal")]),
    ("cp.execSync('a ' + 'b')", [(1, "a b", "literal")]),
    ("execSync(`npm i ${x}`, {stdio: 'inherit'})", [(1, "npm i ${x}", "literal")]),
    ('exec(\n  "curl u" +\n  " | sh")', [(1, "curl u | sh", "literal")]),
    ('const c = "npm i x"\n\nexec(c)', [(1, "npm i x", "literal")]),
    ('const c: string =\n  "npm i x";\nexec(c)', [(2, "npm i x", "literal")]),
    ("exec(c); c = 'late'", []),
    ('let c = getUvPathCommand("uv x");\nterminal.sendText(c)', [(1, "uv x", "literal")]),
    ("spawn('npm', ['--yes', 'install', '-g', 'x'])", [(1, "npm install -g x", "argv")]),
    ("spawn('npm',\n ['i', 'x'])", [(1, "npm i x", "argv")]),
    ("spawn('npm', ['run', 'x'])", [(1, "npm", "literal")]),
    ("spawn('bash', ['-c', 'curl u | sh'])", [(1, "curl u | sh", "argv")]),
    ("execFile('curl', ['-o', out, ...rest, `u/${v}`, ...['q'], true])", [(1, "curl -o $out u/${v} q", "argv")]),
    ("spawn(brewPath, ['install', 'x'])", [(1, "brew install x", "argv")]),
    ("// exec('no')\n/* exec('no') */ exec('yes')", [(2, "yes", "literal")]),
    ("a = /[\"'(]/g; exec('x')", [(1, "x", "literal")]),
    ("a = b / c; exec('x'); d = e / f", [(1, "x", "literal")]),
    ("s = \"exec('no')\"; exec(s)", [(1, "exec('no')", "literal")]),
    ("exec('it\\'s')", [(1, "it's", "literal")]),
    ("/* never closed exec('x')", []),
    ("exec('open", []),
    ("executor('x'); myexec('y'); exec ('z')", [(1, "z", "literal")]),
    ("", []),
]


@pytest.mark.parametrize("source, want", PYTHON)
def test_python(source, want):
    assert python_commands(source) == want


@pytest.mark.parametrize("source, want", SCRIPTS)
def test_javascript(source, want):
    assert javascript_commands(source) == want


def test_files_and_findings(spark):
    body = 'import os\nos.system("curl http://u/x | sudo bash")'
    rows = [("a/b.py", "source_code", body), ("a/B.PY", "source_code", body), ("tests/b.py", "source_code", body), ("x/test_b.py", "source_code", body), ("x/b_test.py", "source_code", body), ("a/b.py", "script", body), ("a/c.ts", "source_code", "exec('pip install q')"), ("a/c.spec.ts", "source_code", "exec('pip install q')"), ("n.py", "source_code", None), ("e.js", "source_code", "")]
    commands = source_commands(spark.createDataFrame(rows, "path string, file_type string, content string"))
    got = sorted(map(tuple, commands.select("path", "line_number", "command", "matched").collect()))
    line = 'os.system("curl http://u/x | sudo bash")'
    assert got == [("a/B.PY", 2, "curl http://u/x | sudo bash", line), ("a/b.py", 2, "curl http://u/x | sudo bash", line), ("a/c.ts", 1, "pip install q", "exec('pip install q')")]
    found = command_findings(commands).select("path", "line_number", "rule", "dependency", "severity")
    assert sorted(map(tuple, found.where("rule <> 'link-host'").collect())) == [("a/B.PY", 2, "pipe-to-shell", "bash", "critical"), ("a/b.py", 2, "pipe-to-shell", "bash", "critical"), ("a/c.ts", 1, "pip-install", "q", "medium")]
    assert source_commands(spark.createDataFrame([], "path string, file_type string, content string")).count() == 0
