"""The same statistics over unbounded catalogs."""
