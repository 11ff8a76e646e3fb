"""What a run leaves in the shared folder."""

import os
import subprocess
import sys
import textwrap

from strandforge import session


def test_clean_deletes_what_the_run_wrote(spark):
    kept = session.materialize(spark.range(5), "kept")
    assert kept.count() == 5 and session.scratch(spark, "x") != session.scratch(spark, "x")
    folder = session.run_dir(spark).removeprefix("file://")
    assert os.listdir(folder)
    session.clean(spark)
    assert not os.path.exists(folder)
    session.clean(spark)
    assert session.materialize(spark.range(3), "again").count() == 3 and session.run_dir(spark).removeprefix("file://") != folder


def test_nothing_is_left_when_the_driver_ends(tmp_path):
    code = f"""
    import sys
    sys.path.insert(0, {os.path.dirname(session.PACKAGE.as_posix())!r})
    from pyspark.sql import SparkSession
    from strandforge import session
    spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.ui.enabled", "false").getOrCreate()
    print(session.materialize(spark.range(7), "x").count(), session.shared_dir(spark))
    spark.stop()
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300)
    assert f"7 file://{tmp_path}/shared" in out.stdout
    assert list((tmp_path / "shared" / "strandforge").iterdir()) == []
