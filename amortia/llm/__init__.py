"""Training-data operators: quality rules, chat formatting, language-model scoring, de-duplication,
decontamination, tokenisation, language identification. Nothing else in the library imports this
subpackage. Executors need the package on their Python path (``--py-files``) for the operators that
run Python in tasks."""
