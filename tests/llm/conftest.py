import sys
from pathlib import Path

#: This folder is a package, as a file of the folder above bears the name of one here; its tests also import each other by name.
sys.path.insert(0, str(Path(__file__).parent))
