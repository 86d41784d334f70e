"""``python -m folioforge <stage>``."""

from folioforge.cli import main

main()
