"""The suite as a whole."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_everything_is_collected():
    command = [sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"]
    found = subprocess.run(command, cwd=ROOT, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-2000:]
