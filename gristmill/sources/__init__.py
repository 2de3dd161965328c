"""Reading raw text, lakes, query files and generated rows; writing results."""
