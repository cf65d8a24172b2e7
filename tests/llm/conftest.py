from __future__ import annotations

import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
# tasks import the helpers of this folder too
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent.parent), os.environ.get("PYTHONPATH", "")])
