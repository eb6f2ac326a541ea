"""python -m quadloom MANIFEST ROOT [STEP], or python -m quadloom query ROOT SPARQL."""

import sys

from quadloom.plans.loader import main

sys.exit(main(sys.argv[1:]))
