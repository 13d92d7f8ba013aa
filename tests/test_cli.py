import numpy as np
import pytest

from eqtlake import cli

from . import support

REGION = ["--snp-chrpos", "1:1-10", "--probe-chrpos", "1:1-10"]


@pytest.mark.parametrize(
    "options,message",
    [
        (["--besd-index", "x", "--index", "y"], "needs --beqtl-summary"),
        (["--beqtl-summary", "x", "--snp", "a"], "needs --out"),
        (["--beqtl-summary", "x", "--out", "o", "--snp", "a", "--probe", "b"], "mutually exclusive"),
        (["--beqtl-summary", "x", "--out", "o", "--snp", "a", *REGION], "Cannot combine --snp/--probe/--gene"),
        (["--beqtl-summary", "x", "--out", "o", "--snp-chrpos", "1:1"], "a SNP region and a probe region"),
        (["--beqtl-summary", "x", "--out", "o", *REGION, "--snp-chr", "1"], "--snp-chrpos excludes"),
        (["--beqtl-summary", "x", "--out", "o", *REGION, "--from-snp-bp", "0"], "--snp-chrpos excludes"),
        (["--beqtl-summary", "x", "--out", "o", "--snp-chrpos", "1:9-2", "--probe-chrpos", "1:1"], "--snp-chrpos: Invalid range"),
        (["--beqtl-summary", "x", "--out", "o", "--snp-chrpos", "1:1", "--probe-chr", "1"], "go together"),
        (
            "--beqtl-summary x --out o --snp-chr 1 --from-snp-kb 1 --from-snp-bp 1 --to-snp-kb 2 --probe-chr 1".split(),
            "--from-snp is given in kb and in bp",
        ),
        (
            "--beqtl-summary x --out o --snp-chr 1 --from-snp-kb 1 --probe-chr 1".split(),
            "lacks --to-snp-kb or --to-snp-bp",
        ),
        (
            "--beqtl-summary x --out o --from-snp-kb 1 --to-snp-kb 2 --probe-chr 1 --from-probe-kb 1 --to-probe-kb 2".split(),
            "lacks --snp-chr",
        ),
    ],
)
def test_errors(capsys, options, message):
    assert cli.main(options) == 1
    assert message in capsys.readouterr().err


def test_source_is_required():
    with pytest.raises(SystemExit):
        cli.main(["--out", "o"])


def test_missing_store(spark, tmp_path, capsys):
    assert cli.main(["--besd-index", str(tmp_path / "no"), "--out", "o", "--snp", "a"], spark) == 1
    assert "not found" in capsys.readouterr().err


def test_index_then_queries(spark, tmp_path, capsys):
    prefix, folder = support.make_files(tmp_path), str(tmp_path / "store")
    assert cli.main(["--beqtl-summary", prefix, "--index", folder], spark) == 0
    assert cli.main(["--beqtl-summary", prefix, "--index", folder], spark) == 1
    reports = []
    for source in (["--beqtl-summary", prefix], ["--besd-index", folder]):
        out = tmp_path / "deep" / source[0].strip("-")
        assert cli.main([*source, "--snp", "snA, none,snA", "--out", str(out), "--query", "1"], spark) == 0
        reports.append((tmp_path / "deep" / f"{out.name}.txt").read_text())
    assert reports[0] == reports[1]
    lines = reports[0].splitlines()
    assert lines[0].split("\t")[:3] == ["SNP", "SNP_Chr", "SNP_bp"]
    p = support.p_value(0.5, float(np.float32(0.1)))
    assert lines[1].split("\t") == [*"snA 1 100 A G p0 1 150 G1 0.500000 0.100000".split(), f"{p:.6e}"]
    assert len(lines) == 3
    printed = capsys.readouterr().out
    assert "  snA: 3 associations" in printed and "  none: 0 associations" in printed


def test_window_and_empty_results(spark, tmp_path, capsys):
    prefix = support.make_files(tmp_path)
    window = "--snp-chr 1 --from-snp-kb 0.1 --to-snp-bp 300 --probe-chr 1 --from-probe-bp 0 --to-probe-kb 1".split()
    assert cli.main(["--beqtl-summary", prefix, *window, "--out", str(tmp_path / "w"), "--query", "1e-300"], spark) == 0
    assert (tmp_path / "w.txt").read_text().count("\n") == 1
    assert cli.main(["--beqtl-summary", prefix, "--gene", "none", "--out", str(tmp_path / "e")], spark) == 0
    assert not (tmp_path / "e.txt").exists()
    assert "Found 0 associations" in capsys.readouterr().out
