"""The analytics queries do not need the training-data part."""
import subprocess
import sys
import textwrap


def test_entry_without_a_library_of_the_training_data_part():
    code = textwrap.dedent("""
        import sys
        sys.modules["public_tokenizers"] = None
        import __spark_entry__ as e
        q = e.queries()
        assert len(q) > 240 and not any(n.startswith("op") and n[2].isdigit() for n in q) and "pipeline" not in q, len(q)
        assert set(e.oracle_sql()) <= set(q)
    """)
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])
