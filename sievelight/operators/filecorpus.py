"""File-corpus audit over `files(source, name, text)`; `source` is the directory, `name` a file directly in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelight.functions.compat import is_json, regex, trim
from sievelight.operators.findings import as_findings, text, union_findings

# File names and risk patterns.
REQUIRED_FILES = ("SKILL.md", "run.mjs", "test.mjs")
AGENT_CARDS = ("agent.md", "AGENT.md")
SKILL_CARD = "SKILL.md"
RUNNERS = ("run.mjs", "server.mjs", "main.mjs", "index.mjs")
MANIFESTS = ("mcp.json", "package.json", "manifest.json")
FRONT_MATTER = r"^---\s*[\s\S]*?\bname:\s*\S+[\s\S]*?\bdescription:\s*\S+[\s\S]*?---"
OVERBROAD = (
    r"\btools\s*:\s*(\*|\"all\"|'all'|\[\s*\*\s*\])|allow[^:\n]{0,40}:\s*(shell|anything|all\b)"
    r"|run\s+any\s+(command|thing|tool)"
)
UNSAFE = (
    r"fetch\s*\(|http\s*\.\s*request|https\s*\.\s*request|WebSocket\s*\(|child_process|execSync|eval\s*\(|rm\s+-rf"
)
LOCAL = r"localhost|127\.0\.0\.1"
SECRET = r"sk-[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{16}|api[_-]?key\s*[:=]\s*[\"'][^\"' ]{6,}[\"']"
SECRET_FILES = r"\.(md|mjs|json)$"
NODE_TESTS, PYTHON_TESTS, SOLUTION = r"^{folder}/[^/]*\.test\.m?js$", r"^tests/test_[^/]*\.py$", r"^[^/]*\.sln$"


def missing_file(files: DataFrame, required: Sequence[str] = REQUIRED_FILES) -> DataFrame:
    """Required names absent from a directory; the agent card counts in either spelling."""
    name = F.col("name")
    have = [F.bool_or(name == r).alias(f"f{i}") for i, r in enumerate(required)]
    dirs = files.groupBy("source").agg(*have, F.bool_or(name.isin(*AGENT_CARDS)).alias("card"))
    marks = [F.when(~F.col(f"f{i}"), F.lit(r)) for i, r in enumerate(required)]
    marks.append(F.when(~F.col("card"), F.lit(AGENT_CARDS[0])))
    missing = dirs.select("source", F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("name"))
    return as_findings(missing, "missing-file", text(name, " missing from the scaffold"), key=name)


def overbroad_scope(files: DataFrame) -> DataFrame:
    """Agent cards that grant tools by wildcard. Where both spellings exist the first one counts."""
    cards = files.filter(F.col("name").isin(*AGENT_CARDS))
    wide = F.col("text").rlike(regex(OVERBROAD, "i"))
    order = F.when(F.col("name") == AGENT_CARDS[0], 0).otherwise(1)
    chosen = cards.groupBy("source").agg(F.min(F.struct(order.alias("order"), F.col("name"), wide.alias("wide"))).alias("card"))
    found = chosen.filter(F.col("card.wide"))
    return as_findings(found, "overbroad-scope", text(F.col("card.name"), " grants tools by wildcard"), key=F.col("card.name"))


def bad_frontmatter(files: DataFrame) -> DataFrame:
    cards = files.filter((F.col("name") == SKILL_CARD) & ~F.col("text").rlike(regex(FRONT_MATTER, "m")))
    return as_findings(cards, "bad-frontmatter", text(F.col("name"), " lacks name/description front matter"), key=F.col("name"))


def unsafe_capability(files: DataFrame, include_text: bool = False) -> DataFrame:
    """First line of each runner file with a network, shell or eval use that is not local."""
    runners = files.filter(F.col("name").isin(*RUNNERS))

    def risky(line: Column) -> Column:
        return line.rlike(regex(UNSAFE, "i")) & ~line.rlike(LOCAL)

    numbered = F.transform(F.split(F.col("text"), "\n", -1), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    first = F.get(F.filter(numbered, lambda x: risky(x["line"])), F.lit(0))
    found = runners.select("source", "name", first.alias("hit")).filter(F.col("hit").isNotNull())
    detail = text(F.col("name"), " runs a network, shell or eval capability")
    if include_text:
        detail = F.concat(detail, F.lit(": "), trim(F.col("hit.line")))
    return as_findings(found, "unsafe-capability", detail, F.col("hit.no"), F.col("name"))


def secret_leak(files: DataFrame, first_only: bool = True) -> DataFrame:
    """Text files holding a key-like secret, by default the first by name in each directory."""
    leaks = files.filter(F.col("name").rlike(regex(SECRET_FILES, "i")) & F.col("text").rlike(regex(SECRET, "i"))).select("source", "name")
    if first_only:
        leaks = leaks.groupBy("source").agg(F.min("name").alias("name"))
    return as_findings(leaks, "secret-leak", text(F.col("name"), " holds a key-like secret in the open"), key=F.col("name"))


def broken_manifest(files: DataFrame) -> DataFrame:
    manifests = files.filter(F.col("name").isin(*MANIFESTS)).filter(~is_json(F.col("text")))
    return as_findings(manifests, "broken-manifest", text(F.col("name"), " is not valid JSON"), key=F.col("name"))


def scaffold_findings(files: DataFrame) -> DataFrame:
    return union_findings(
        [
            missing_file(files),
            overbroad_scope(files),
            bad_frontmatter(files),
            unsafe_capability(files),
            secret_leak(files),
            broken_manifest(files),
        ]
    )


def detect_test_kind(manifest: DataFrame) -> DataFrame:
    """`source, id, kind` from a manifest `source, path` of files relative to their repository."""
    path = F.col("path")
    node = [F.bool_or(path.rlike(regex(NODE_TESTS.format(folder=f)))) for f in ("tests", "test")]
    repos = manifest.groupBy("source").agg(
        (node[0] | node[1]).alias("node"),
        F.bool_or(path.rlike(regex(PYTHON_TESTS)) | (path == "pytest.ini")).alias("py"),
        F.bool_or(path == "Cargo.toml").alias("cargo"),
        F.bool_or(path.rlike(regex(SOLUTION))).alias("dotnet"),
    )

    def step(flag: str, step_id: str, kind: str) -> Column:
        return F.when(F.col(flag), F.struct(F.lit(step_id).alias("id"), F.lit(kind).alias("kind")))

    steps = F.array(
        step("node", "node-test", "node-test"), step("py", "pytest", "cmd"), step("cargo", "cargo-test", "cmd"), step("dotnet", "dotnet-test", "cmd")
    )
    return repos.select("source", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("source", "s.id", "s.kind")
