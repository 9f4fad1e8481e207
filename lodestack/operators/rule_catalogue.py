"""More evidence rules by ecosystem: packages, tools, images, modules and downloads that no manifest declares.

Each rule has an example: a line in which W stands for a name, and what is found in it. `scan(files, CATALOGUE)` reads them,
beside the general rules of text_rules. Rules with a multiple match find every one of a line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from lodestack.operators.text_rules import Rule

NAME, URL, FLAGS = r"[A-Za-z0-9@][A-Za-z0-9@/._+-]*", r"https?://[^\s\"'<>|;)]+", r"(?:-{1,2}[\w-]+(?:=\S+)?\s+)*"
SHELLS = ("script", "ci", "dockerfile", "build", "github_action")
MOVES = ((r"@(?:latest|next|canary|main|master)\b", "high"),)


@dataclass(frozen=True)
class Example:
    """A line and the dependency that its rule finds, the word W being any lower-case one; and a line without one."""

    line: str
    found: str
    none: str

    def about(self, word: str) -> tuple[str, str, str]:
        """The three texts with this word."""
        return tuple(re.sub(r"\bW\b", word, x) for x in (self.line, self.found, self.none))


def _install(id: str, command: str, example: str, severity: str = "medium", escalate: tuple = MOVES, found: str = "W"):
    """A rule for an installing command that is followed by options and a name."""
    words = command.split()
    pattern = r"\b" + r"\s+".join(words) + rf"\s+{FLAGS}({NAME})"
    rule = Rule(id, pattern, 1, "unmanaged_package", severity, SHELLS, escalate=escalate, hints=(words[0],))
    return rule, Example(example, found, re.sub(r"\(\?:(\w+)[^)]*\)", r"\1", command))


_RULES = [
    # package managers of languages
    _install("pnpm-add-global", "pnpm add", "pnpm add --global W"),
    _install("yarn-global", "yarn global add", "yarn global add W"),
    _install("bun-add", "bun add", "bun add --global W"),
    _install("bunx-run", "bunx", "bunx W@latest", found="W@latest"),
    _install("pnpm-dlx", "pnpm dlx", "pnpm dlx W"),
    _install("yarn-dlx", "yarn dlx", "yarn dlx W"),
    _install("deno-install", "deno install", "deno install --allow-net W"),
    _install("pipx-install", "pipx install", "pipx install W"),
    _install("pipx-run", "pipx run", "pipx run W"),
    _install("uv-tool", "uv tool install", "uv tool install W"),
    _install("uv-pip", "uv pip install", "uv pip install W"),
    _install("uvx-run", "uvx", "uvx W"),
    _install("conda-install", "conda install", "conda install --yes W"),
    _install("mamba-install", "mamba install", "mamba install W"),
    _install("easy-install", "easy_install", "easy_install W", "high"),
    _install("go-get", "go get", "go get example.org/W@v1", found="example.org/W@v1"),
    _install("go-run-remote", "go run", "go run example.org/W@latest", "high", found="example.org/W@latest"),
    _install("bundle-add", "bundle add", "bundle add W"),
    _install("composer-require", "composer global require", "composer global require acme/W", found="acme/W"),
    _install("dotnet-tool", "dotnet tool install", "dotnet tool install --global W"),
    _install("dotnet-package", "dotnet add package", "dotnet add package W"),
    _install("nuget-install", "nuget install", "nuget install W"),
    _install("cpanm", "cpanm", "cpanm --notest W"),
    _install("luarocks", "luarocks install", "luarocks install W"),
    _install("opam-install", "opam install", "opam install W"),
    _install("mix-archive", "mix archive.install hex", "mix archive.install hex W"),
    _install("dart-activate", "dart pub global activate", "dart pub global activate W"),
    _install("stack-install", "stack install", "stack install W"),
    _install("cabal-install", "cabal install", "cabal install W"),
    _install("raco-install", "raco pkg install", "raco pkg install --auto W"),
    _install("nimble-install", "nimble install", "nimble install W"),
    _install("cargo-binstall", "cargo binstall", "cargo binstall W"),
    # package managers of systems
    _install("choco-install", "choco install", "choco install -y W", "low"),
    _install("scoop-install", "scoop install", "scoop install W", "low"),
    _install("winget-install", "winget install", "winget install W", "low"),
    _install("snap-install", "snap install", "snap install --classic W", "low"),
    _install("flatpak-install", "flatpak install", "flatpak install -y W", "low"),
    _install("pacman-install", "pacman -S", "pacman -S W", "low"),
    _install("zypper-install", "zypper install", "zypper install W", "low"),
    _install("brew-tap", "brew tap", "brew tap acme/W", found="acme/W"),
    _install("port-install", "port install", "port install W", "low"),
    _install("nix-env", "nix-env -i", "nix-env -i W", "low"),
    # tools that bring plugins, roles and models
    (Rule("helm-repo", rf"\bhelm\s+repo\s+add\s+\S+\s+({URL})", 1, "remote_reference", "medium", SHELLS, hints=("helm",)), Example("helm repo add W https://h.example/W", "https://h.example/W", "helm repo update")),
    (Rule("helm-chart", rf"\bhelm\s+(?:install|upgrade|pull)\s+(?:[\w-]+\s+)?{FLAGS}((?:oci://|https?://)\S+)", 1, "iac_module", "medium", SHELLS, hints=("helm",)), Example("helm pull oci://r.example/W", "oci://r.example/W", "helm install W ./chart")),
    (Rule("kubectl-remote", rf"\bkubectl\s+(?:apply|create)\s+(?:-\S+\s+)*-f\s+({URL})", 1, "iac_module", "high", SHELLS, hints=("kubectl",)), Example("kubectl apply -f https://h.example/W.yaml", "https://h.example/W.yaml", "kubectl apply -f W.yaml")),
    _install("galaxy-install", "ansible-galaxy (?:collection|role) install", "ansible-galaxy collection install acme.W", found="acme.W"),
    _install("puppet-module", "puppet module install", "puppet module install acme-W", found="acme-W"),
    _install("krew-install", "kubectl krew install", "kubectl krew install W"),
    _install("gh-extension", "gh extension install", "gh extension install acme/W", found="acme/W"),
    _install("code-extension", "code --install-extension", "code --install-extension acme.W", found="acme.W"),
    _install("asdf-plugin", "asdf plugin add", "asdf plugin add W"),
    _install("vagrant-box", "vagrant box add", "vagrant box add acme/W", found="acme/W"),
    _install("ollama-pull", "ollama pull", "ollama pull W:latest", found="W"),
    (Rule("model-from-hub", r"\b(?:from_pretrained|hf_hub_download|snapshot_download)\(\s*(?:repo_id\s*=\s*)?[\"']([\w.-]+/[\w.-]+)", 1, "ai_model", "medium", hints=("from_pretrained", "_download")), Example('x = from_pretrained("acme/W")', "acme/W", "x = from_pretrained(path)")),
    (Rule("torch-hub", r"\btorch\.hub\.load\(\s*[\"']([\w.-]+/[\w.-]+(?::[\w.-]+)?)", 1, "ai_model", "high", hints=("hub.load",)), Example("torch.hub.load('acme/W:main', 'x')", "acme/W:main", "torch.hub.load(d, 'x')")),
    # downloads
    (Rule("git-clone", r"\bgit\s+clone\s+(?:-\S+(?:[ =]\S+)?\s+)*((?:https?://|git@|ssh://)\S+)", 1, "remote_reference", "medium", SHELLS, escalate=((r"http://", "high"),), hints=("clone",)), Example("git clone --depth 1 https://h.example/W.git", "https://h.example/W.git", "git clone ../W")),
    (Rule("fetch-to-file", rf"\b(?:curl|wget)\s+(?:[^|\n]*\s)?(?:-o|-O|--output|--output-document)\s*\S*\s+({URL})", 1, "binary_download", "medium", SHELLS, escalate=((r"http://", "high"),), hints=("curl", "wget")), Example("curl -fsSL -o tool https://h.example/W", "https://h.example/W", "curl -fsSL https://h.example/W")),
    (Rule("fetch-and-run", rf"\b(?:curl|wget)\b[^|\n;&]*?({URL})[^|\n]*(?:&&|;)\s*(?:sudo\s+)?(?:chmod\s+\S+|(?:ba|z)?sh)\b", 1, "script_installation", "high", SHELLS, escalate=((r"http://", "critical"),), hints=("curl", "wget")), Example("curl -O https://h.example/W.sh && sh W.sh", "https://h.example/W.sh", "curl -O https://h.example/W.sh && ls")),
    (Rule("powershell-fetch", rf"(?i)\b(?:iwr|invoke-webrequest|start-bitstransfer)\b[^|\n]*?({URL})", 1, "binary_download", "medium", hints=("iwr", "nvoke-", "tart-", "IWR", "NVOKE")), Example("Invoke-WebRequest -Uri https://h.example/W -OutFile x", "https://h.example/W", "Invoke-WebRequest $u")),
    (Rule("certutil-fetch", rf"(?i)\bcertutil(?:\.exe)?\s[^|\n]*-urlcache[^|\n]*?({URL})", 1, "binary_download", "critical", hints=("certutil", "CERTUTIL", "Certutil")), Example("certutil -urlcache -f https://h.example/W x", "https://h.example/W", "certutil -hashfile W")),
    (Rule("python-exec-remote", rf"\bpython3?\s+(?:-\w+\s+)*<\(\s*(?:curl|wget)\s[^)]*?({URL})", 1, "script_installation", "critical", SHELLS, hints=("python",)), Example("python3 <(curl -s https://h.example/W.py)", "https://h.example/W.py", "python3 W.py")),
    # registries
    (Rule("pip-index", rf"--(?:extra-)?index-url[ =]({URL})", 1, "registry_override", "high", hints=("index-url",)), Example("pip install --extra-index-url https://h.example/W x", "https://h.example/W", "pip install x")),
    (Rule("npm-registry", rf"\b(?:registry|npm_config_registry)\s*[ =]\s*({URL})", 1, "registry_override", "medium", hints=("registry",)), Example("registry=https://h.example/W", "https://h.example/W", "registry=default")),
    (Rule("apt-source", rf"\bdeb(?:-src)?\s+(?:\[[^\]]*\]\s+)?({URL})", 1, "registry_override", "medium", hints=("deb",)), Example("deb [arch=amd64] https://h.example/W stable main", "https://h.example/W", "deb cdrom:x")),
    (Rule("apt-ppa", r"\badd-apt-repository\s+(?:-\S+\s+)*[\"']?(ppa:[\w.-]+/[\w.-]+)", 1, "registry_override", "medium", SHELLS, hints=("ppa:",)), Example("add-apt-repository -y ppa:acme/W", "ppa:acme/W", "add-apt-repository universe")),
    # pipelines
    (Rule("action-image", r"\buses:\s*docker://(\S+)", 1, "cicd_tool", "medium", ("ci", "github_action"), escalate=((r":latest\b", "high"),), hints=("docker://",)), Example("uses: docker://acme/W:1", "acme/W:1", "uses: ./W")),
    (Rule("remote-include", rf"\b(?:remote|include):\s*[\"']?({URL})", 1, "cicd_tool", "high", ("ci",), hints=("remote:", "include:")), Example("remote: https://h.example/W.yml", "https://h.example/W.yml", "remote: W")),
    (Rule("ci-orb", r"^\s*[\w-]+:\s*([\w-]+/[\w-]+@(?:\d[\w.]*|volatile|dev:\S+))\s*$", 1, "cicd_tool", "medium", ("ci",), escalate=((r"@(?:volatile|dev:)", "high"),), hints=("@",)), Example("  x: acme/W@1.2", "acme/W@1.2", "  x: acme/W")),
    (Rule("pipeline-image", r"^\s*image:\s*[\"']?([\w.-]+(?:[./:@][\w.@:-]+)*)", 1, "container_image", "low", ("ci", "k8s"), escalate=((r":latest\b", "high"),), hints=("image:",)), Example("  image: acme/W:latest", "acme/W:latest", "  image:")),
    (Rule("pre-commit-repo", rf"^\s*-\s*repo:\s*({URL})", 1, "cicd_tool", "medium", ("precommit_config",), hints=("repo:",)), Example("- repo: https://h.example/W", "https://h.example/W", "- repo: local")),
    (Rule("copy-from-image", r"(?i)^\s*COPY\s+--from=([\w.-]+[/:][\w./:@-]+)", 1, "container_image", "medium", ("dockerfile",), escalate=((r":latest\b", "high"),), hints=("--from=",)), Example("COPY --from=acme/W:1 /a /b", "acme/W:1", "COPY --from=W /a /b")),
    (Rule("add-remote", rf"(?i)^\s*ADD\s+(?:--\S+\s+)*({URL})", 1, "binary_download", "high", ("dockerfile",), escalate=((r"http://", "critical"),), hints=("ADD", "add")), Example("ADD https://h.example/W /x", "https://h.example/W", "ADD W /x")),
    # builds and infrastructure
    (Rule("cmake-fetch", rf"\b(?:GIT_REPOSITORY|URL)\s+[\"']?((?:https?|git)://\S+?)[\"')]*$", 1, "build_dependency", "medium", ("build",), hints=("GIT_REPOSITORY", "URL")), Example("  GIT_REPOSITORY https://h.example/W.git", "https://h.example/W.git", "  GIT_TAG W")),
    (Rule("cmake-cpm", r"\bCPMAddPackage\(\s*[\"']?((?:gh|gl|bb):[\w./-]+[#@]?[\w.-]*)", 1, "build_dependency", "medium", ("build",), hints=("CPMAddPackage",)), Example('CPMAddPackage("gh:acme/W#1.0")', "gh:acme/W#1.0", "CPMAddPackage(W)")),
    (Rule("gradle-remote-script", rf"\bapply\s*\(?\s*from\s*[:=]\s*[\"']({URL})", 1, "build_dependency", "high", ("build",), hints=("from",)), Example("apply from: 'https://h.example/W.gradle'", "https://h.example/W.gradle", "apply from: 'W.gradle'")),
    (Rule("maven-repository", rf"<url>\s*({URL})", 1, "registry_override", "low", ("build",), hints=("<url>",)), Example("<url>https://h.example/W</url>", "https://h.example/W", "<url>${W}</url>")),
    (Rule("terraform-module", r"\bsource\s*=\s*\"((?:git::|github\.com/|https?://|s3::|gcs::)[^\"]+)\"", 1, "iac_module", "medium", ("iac",), escalate=((r"\?ref=(?:main|master)\b", "high"),), hints=("source",)), Example('source = "git::https://h.example/W.git?ref=main"', "git::https://h.example/W.git?ref=main", 'source = "./W"')),
    (Rule("make-include", rf"^\s*-?include\s+({URL})", 1, "build_dependency", "high", ("build",), hints=("include",)), Example("include https://h.example/W.mk", "https://h.example/W.mk", "include W.mk")),
    # programs and pages
    (Rule("r-install", r"\binstall\.packages\(\s*[\"']([\w.]+)", 1, "unmanaged_package", "medium", hints=("install.packages",)), Example('install.packages("W")', "W", "install.packages(p)")),
    (Rule("r-github", r"\b(?:install_github|pak::pak|pkg_install)\(\s*[\"']([\w.-]+/[\w.-]+)", 1, "unmanaged_package", "high", hints=("install_github", "pak", "pkg_install")), Example('install_github("acme/W")', "acme/W", "install_github(p)")),
    (Rule("julia-add", r"\bPkg\.add\(\s*(?:url\s*=\s*)?[\"']([^\"']+)", 1, "unmanaged_package", "medium", hints=("Pkg.add",)), Example('Pkg.add("W")', "W", "Pkg.add(p)")),
    (Rule("module-from-url", r"\b(?:from|import)\s*\(?\s*[\"'](https?://[^\"']+)", 1, "cdn", "high", ("source_code", "html"), multiple=True, hints=("://",)), Example("import x from 'https://esm.example/W'", "https://esm.example/W", "import x from './W'")),
    (Rule("worker-scripts", r"\bimportScripts\(\s*[\"'](https?://[^\"']+)", 1, "cdn", "high", ("source_code", "html"), hints=("importScripts",)), Example("importScripts('https://h.example/W.js')", "https://h.example/W.js", "importScripts('W.js')")),
    (Rule("style-import", r"(?i)@import\s+(?:url\()?[\"']?(https?://[^\"')\s;]+)", 1, "cdn", "low", hints=("@import", "@IMPORT")), Example("@import url('https://h.example/W.css');", "https://h.example/W.css", "@import 'W.css';")),
    (Rule("stylesheet-cdn", r"(?i)<link\b[^>]*\bhref=[\"'](https?://[^\"']+\.css[^\"']*)", 1, "cdn", "low", ("html", "text"), multiple=True, hints=("<",)), Example('<link rel="stylesheet" href="https://h.example/W.css">', "https://h.example/W.css", '<link rel="x" href="W.css">')),
    (Rule("frame-source", r"(?i)<iframe\b[^>]*\bsrc=[\"'](https?://[^\"']+)", 1, "remote_reference", "medium", ("html", "text"), multiple=True, hints=("<",)), Example('<iframe src="https://h.example/W"></iframe>', "https://h.example/W", '<iframe src="W"></iframe>')),
]

CATALOGUE: list[Rule] = [r for r, _ in _RULES]
EXAMPLES: dict[str, Example] = {r.id: e for r, e in _RULES}
