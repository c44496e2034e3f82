"""Reading examples, catalogs and reports, and writing them back."""
