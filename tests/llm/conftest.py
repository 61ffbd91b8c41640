import sys
from pathlib import Path

# Modules of these tests use each other's brute-force versions.
sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[2])]
