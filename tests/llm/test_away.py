"""Every query of the subpackage runs where workers cannot import it."""

import os
import subprocess
import sys


def test_queries_run_where_the_package_is_not_installed(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as d\n"
        "from quillvec.session import build_session\n"
        "s = build_session('t', 'local[4]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '4'})\n"
        "for name in [*d.LLM, *d.PIPELINE]:\n"
        "    d.queries()[name](s, '/root/testdata/sf0.001').write.format('noop').mode('overwrite').save()\n"
        "    print('ran', name, flush=True)\n"
        "print('all ran')\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stdout + done.stderr[-2000:]
