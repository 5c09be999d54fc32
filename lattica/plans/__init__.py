"""Model plans and the algebraic rewrites that choose between equal ones."""
