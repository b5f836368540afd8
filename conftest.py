"""Makes the repository importable from any working directory."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
